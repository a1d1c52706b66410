"""Host-level quality rules in DataFrame operations only.

Every document is judged by rules. For each rule the failures of a host's documents give its failure rate,
shrunk towards the other hosts by a beta prior of that rule, which is fitted to all hosts (method of moments):
a host of few documents says little, one of many speaks for itself. A host is rejected by a rule if its
rate, less ``DEVIATIONS`` posterior standard deviations, lies over the middle between the prior's mean and one:
then most of its documents break the rule, and far more than hosts usually have. The verdict is joined back.

Null text has no words; a null host is a host of its own; null and repeated ids are kept row by row. An empty
table gives no rows. Only the id, host and text columns are read. A long text is handled by one task, as arrays
of its words, lines and windows.

Windows of three words are compared by 64-bit hashes within one text.
"""

from pyspark.sql import Column, DataFrame, functions as F

from pairwise.session import stage

MIN_WORDS = 50
MAX_REPEATED = 50  # percent of the words
RULES = ("short", "repeats", "symbols", "dup_lines", "word_length")
DEVIATIONS = 2
LEAST_SHARE, MOST_SHARE = 1e-4, 0.5  # of the largest possible variance between hosts: priors weigh 1 to 9,999 documents
WORD_GAP = r"[\x20\x09-\x0D]+"
SYMBOLS = r"[#*$%&|<>]"


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once, whatever ``body`` does with it."""
    return F.transform(F.array(value), body)[0]


def _repeated(hashes: Column) -> Column:
    """Words covered by three-word windows that occur more than once."""

    def covered(ordered: Column) -> Column:
        def again(x: Column, i: Column) -> Column:
            before = F.get(ordered, i - 1)["h"]
            after = F.get(ordered, i + 1)["h"]
            return F.coalesce(x["h"] == before, F.lit(False)) | F.coalesce(x["h"] == after, F.lit(False))

        starts = F.filter(ordered, again)
        return F.size(F.array_distinct(F.flatten(F.transform(starts, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))))

    placed = F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return _let(F.sort_array(placed), covered)


def _windows(words: Column) -> Column:
    n = F.size(words) - 2
    return F.when(
        n > 0,
        F.transform(
            F.sequence(F.lit(0), F.greatest(n, F.lit(1)) - 1),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def base_counts(df: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """doc_id, host, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words for every row."""
    whole = F.coalesce(F.col(text), F.lit(""))
    words = F.filter(F.split(whole, WORD_GAP), lambda w: w != "")
    lines = F.filter(F.split(whole, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))

    def in_words(w: Column) -> Column:
        windows = _let(
            _windows(w), lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), 0).otherwise(_repeated(h))
        )
        return F.struct(
            F.size(w).cast("bigint").alias("n_words"),
            F.length(F.array_join(w, "")).cast("bigint").alias("word_chars"),
            windows.cast("bigint").alias("n_repeat_words"),
        )

    return df.select(
        F.col(key).alias("doc_id"),
        F.col(host).alias("host"),
        _let(words, in_words).alias("in_words"),
        F.regexp_count(whole, F.lit(SYMBOLS)).cast("bigint").alias("n_symbols"),
        _let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("bigint").alias("n_dup_lines"),
    ).select("doc_id", "host", "in_words.*", "n_symbols", "n_dup_lines")


def with_failures(counts: DataFrame) -> DataFrame:
    """base_failed, a column failed_<rule> for each rule, and n_failed: how many rules the document breaks."""
    n = F.col("n_words")
    rules = (
        n < MIN_WORDS,
        100 * F.col("n_repeat_words") > MAX_REPEATED * n,
        10 * F.col("n_symbols") > n,  # more than one symbol in ten words
        2 * F.col("n_dup_lines") > n,  # more repeated lines than half the words
        (F.col("word_chars") < 2 * n) | (F.col("word_chars") > 15 * n),
    )
    failed = {f"failed_{name}": rule for name, rule in zip(RULES, rules, strict=True)}
    number = sum((rule.cast("int") for rule in rules[1:]), rules[0].cast("int"))
    return counts.withColumns(failed | {"base_failed": rules[0] | rules[1], "n_failed": number})


def host_rates(judged: DataFrame) -> DataFrame:
    """One row for each host: n_docs, n_bad (documents that break any rule), and for each rule the number of
    documents that break it (docs_<rule>), the shrunk rate (rate_<rule>) and whether it rejects the host; host_rejected."""
    hosts = judged.groupBy("host").agg(
        F.count("*").alias("n_docs"),
        F.count_if(F.col("n_failed") > 0).alias("n_bad"),
        *[F.count_if(f"failed_{name}").alias(f"docs_{name}") for name in RULES],
    )
    hosts = stage(hosts, "hosts")
    rates, rejects = {}, {}
    for name, (a, b) in zip(RULES, beta_priors(hosts, [f"docs_{name}" for name in RULES]), strict=True):
        size = F.col("n_docs") + (a + b)
        rate = (F.col(f"docs_{name}") + a) / size
        deviation = F.sqrt(rate * (1 - rate) / (size + 1))
        rates[f"rate_{name}"] = rate
        rejects[f"rejects_{name}"] = rate - DEVIATIONS * deviation > (1 + a / (a + b)) / 2
    told = hosts.withColumns(rates | rejects)
    return told.withColumn("host_rejected", F.greatest(*rejects))


def beta_priors(hosts: DataFrame, failures: list[str]) -> list[tuple[float, float]]:
    """The two parameters of each rule's prior by moments over the hosts, each of which counts once.

    Of k failures among n documents, k / n estimates a host's rate and k (k - 1) / (n (n - 1)) its square,
    both without bias. Their means over the hosts of two or more documents give the mean and the variance
    of the rates; the variance's share r of its largest value, kept between LEAST_SHARE and MOST_SHARE,
    gives a + b = 1 / r - 1. Without such hosts both parameters are 1.
    """
    n = F.col("n_docs").cast("double")
    moments = []
    for name in failures:
        k = F.col(name).cast("double")
        moments += [F.avg(k / n), F.avg(k * (k - 1) / (n * (n - 1)))]
    row = hosts.filter("n_docs > 1").agg(*moments).first()
    priors = []
    for mean, square in zip(row[::2], row[1::2], strict=True):
        if mean is None:
            priors.append((1.0, 1.0))
            continue
        mean = min(max(mean, 1e-6), 1 - 1e-6)
        r = min(max((square - mean * mean) / (mean - mean * mean), LEAST_SHARE), MOST_SHARE)
        size = 1 / r - 1
        priors.append((mean * size, (1 - mean) * size))
    return priors


def host_rules(df: DataFrame, key: str = "doc_id", host: str = "source", text: str = "text") -> DataFrame:
    """Counts and failures of each row, its host's figures by rule, and ``kept``."""
    judged = stage(with_failures(base_counts(df, key, host, text)), "rules")
    rates = host_rates(judged).withColumnRenamed("host", "of_host")
    joined = judged.join(rates, F.col("host").eqNullSafe(F.col("of_host")), "left").drop("of_host")
    return joined.withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
