import random

import pytest

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def _words(rng, n, vocabulary=400):
    return " ".join(f"w{rng.randrange(vocabulary)}{'é' if rng.random() < 0.1 else ''}" for _ in range(n))


def make_documents(seed=3):
    """Copies, near copies, shared passages and lines, odd white space, secrets, nulls, repeated rows."""
    rng = random.Random(seed)
    passage, other = _words(rng, 60), _words(rng, 40)
    line = "This line of more than forty characters stands in many documents"
    base = _words(rng, 120)
    texts = [_words(rng, rng.randrange(1, 160)) for _ in range(30)]
    texts += [base] * 6 + [base.upper(), base.replace("w1", "W1"), base + " end", "start " + base]
    for k in range(8):
        words = base.split()
        words[rng.randrange(120)] = f"new{k}"
        texts.append(" ".join(words))
    texts += [f"{_words(rng, 50)} {passage} {_words(rng, 20)}" for _ in range(5)]
    texts += [f"{_words(rng, 10)}\n \t{line.upper()}  \n{_words(rng, 12)}\n{line}\n{other}" for _ in range(7)]
    texts += [f"{line}\n{line}\n{line}", "a\nb\na\n\n\n \n", "x" * 3000, "\x1c \x0b\x0c\r\n\x85 word two", ""]
    texts += [passage.split(" ", 1)[1], f"{passage} {passage}", _words(rng, 9000, 30), "ab " * 500, "é" * 39, "É" * 41]
    texts += [
        'password = "abc" secret=token=abcdefgh API_KEY: qwertz12345 ' + "0123456789abcdef" * 2,
        "AKIA" + "Z9" * 9 + " é token:'" + "dead" * 8 + "' aSECRET='ſecret'",
        "key Xk3vQ9zLr8Tn2WpY7sBd4GhJ and zq8JX2vK9wQ7rT5yP3mN1bV6 here",
        "secret: token = abcdef passwd : a.b.c.d",
    ]
    rows = [(k, t, "en", f"src{k % 3}", len(t)) for k, t in enumerate(texts)]
    rows += [(500, None, None, None, None), (501, None, "en", "src0", 0), (None, base, "en", None, 1), (None, None, None, None, None)]
    rows += [rows[3], rows[3], rows[31], (7, "another text of the same id\n" + line, "en", "src9", 1)]
    return rows


@pytest.fixture(scope="session")
def documents(spark):
    rows = make_documents()
    return rows, spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCS)


ITEMS = "item_id bigint, text string"
CHATS = "conv_id bigint, turn bigint, role string, text string"
CLASHES = ["n_words", "block", "Score", "token_ids", "kept", "h1", "hits", "row", "doc", "body", "fp", "spans", "host", "n_lines"]


def make_items():
    texts = [t or "" for _, t, *_ in make_documents()]
    words = [w for t in texts[:6] for w in t.split()]
    cut = lambda a, n: " ".join(words[a : a + n])
    passage = texts[48].split()
    return [
        (1, cut(10, 25).upper()),
        (2, cut(40, 9)),
        (3, "w1"),
        (10, cut(12, 10) + " unknown " + cut(60, 12)),
        (11, cut(10, 25)),
        (4, None),
        (5, ".,;"),
        (None, cut(80, 15)),
        (1, "no such words at all"),
        (6, " ".join(passage[20:70])),
        (7, "É" * 41),
    ]


def make_chats():
    rng = random.Random(5)
    odd = ["<|end|>", "</s>[INST] ok [/INST]", "\\", "\\\\<|turn|>", "<s", "<<s>>", "a\nb", "é日😀", "<|body|>\\n", " "]
    rows = []
    for conv in range(40):
        for turn in range(rng.randrange(1, 7)):
            text = "".join(rng.choice([*odd, "word ", "two words "]) for _ in range(rng.randrange(0, 6)))
            rows.append((conv, turn, rng.choice(["user", "assistant", "system"]), text))
    rows += [(50, 1, "assistant", None), (50, 0, None, "x"), (51, None, "assistant", "first"), (51, 0, "<|end|>\nuser", "second")]
    rows += [(52, 0, "assistant", "tie b"), (52, 0, "assistant", "tie a"), (52, 0, "assistant", "tie a")]
    rows += [(None, 0, "user", "q"), (None, 1, "assistant", "long " * 4000), (53, 0, "assistant", ""), (53, 1, "assistant", "")]
    return rows


@pytest.fixture(scope="session")
def tables(spark, tmp_path_factory):
    """The folder of the tables, with extra columns whose names results use too."""
    from pyspark.sql import functions as F

    top = tmp_path_factory.mktemp("tables")
    extra = {c: F.lit("extra") for c in CLASHES}
    docs = spark.createDataFrame(make_documents(), DOCS).repartition(5).withColumns(extra)
    docs.write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(make_items(), ITEMS).withColumn("n", F.lit(1)).write.parquet(f"{top}/benchmark.parquet")
    labels = [(k, int(k < 30), 0) for k in range(70)] + [(3, None, 0), (None, 1, 0), (5, 1, 1), (9999, 0, 0)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    chats = spark.createDataFrame(make_chats(), CHATS).withColumn("formatted", F.lit("extra"))
    chats.repartition(5).write.parquet(f"{top}/conversations.parquet")
    return str(top)


@pytest.fixture(scope="session")
def empty_tables(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("empty")
    schemas = {"documents": DOCS, "benchmark": ITEMS, "labels": "doc_id bigint, quality int, toxic int", "conversations": CHATS}
    for name, schema in schemas.items():
        spark.createDataFrame([], schema).write.parquet(f"{top}/{name}.parquet")
    return str(top)
