"""Plain versions of the query contracts, for small inputs."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from itertools import combinations

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def rules(text):
    words = WORD.findall(text or "")
    lines, seen, dup = (text or "").split("\n"), set(), 0
    for line in lines:
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    count = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if count[w] > 1 for k in range(3)}
    n = len(words)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return n, sum(map(len, words)), symbols, dup, len(covered), n < 50 or 100 * len(covered) > 50 * n


def contamination(docs, items, window=10):
    word = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    wins = defaultdict(set)
    for item, text in items:
        words = word.findall((text or "").translate(LOWER))
        size = min(window, len(words))
        for i in range(len(words) - size + 1 if words else 0):
            wins[tuple(words[i : i + size])].add(item)
    sizes = {len(w) for w in wins}
    out = []
    for doc, text in docs:
        words, hit, found = word.findall((text or "").translate(LOWER)), set(), set()
        for size in sizes:
            for i in range(len(words) - size + 1):
                if (w := tuple(words[i : i + size])) in wins:
                    hit |= set(range(i, i + size))
                    found |= wins[w]
        found = sorted(str(x) for x in found if x is not None)
        out.append((doc, len(words), len(hit), len(found), sha(",".join(found)), bool(hit)))
    return out


def repeats(docs, window=35):
    split = [(doc, WORD.findall(text or "")) for doc, text in docs]
    count = Counter(tuple(w[i : i + window]) for _, w in split for i in range(len(w) - window + 1))
    out = []
    for doc, w in split:
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone |= set(range(i, i + window))
        out.append((doc, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def secrets(text):
    text, kinds = text or "", ("assign", "access", "hex")
    assign = r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
    spans = [("assign", *m.span()) for m in re.finditer(assign, text) if len(m[1]) >= 6]
    spans += [("access", *m.span()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    spans += [("hex", *m.span()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    spans.sort(key=lambda s: (s[1], kinds.index(s[0])))
    n = Counter(k for k, _, _ in spans)
    return n["assign"], n["access"], n["hex"], sha(",".join(f"{k}:{a}:{b}" for k, a, b in spans))


def simhash(text):
    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(docs):
    """Fingerprint and class of each document."""
    prints = [simhash(text) for _, text in docs]
    parent = list(range(len(docs)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                parent[root(i)] = root(j)
    return [(p, root(i)) for i, p in enumerate(prints)]


def classes(docs):
    least, found = {}, groups(docs)
    for (doc, _), (_, group) in zip(docs, found, strict=True):
        if doc is not None:
            least[group] = min(doc, least.get(group, doc))
    return [(doc, f"{p:016x}", least.get(g)) for (doc, _), (p, g) in zip(docs, found, strict=True)]


def lines(docs, min_chars=40, min_docs=5):
    def key(line):
        return line.strip(" \t\n\x0b\x0c\r").translate(LOWER)

    holders = defaultdict(set)
    rank = lambda doc: -(1 << 63) if doc is None else doc
    for doc, text in docs:
        for line in (text or "").split("\n"):
            if len(key(line)) >= min_chars:
                holders[key(line)].add(rank(doc))
    out = []
    for doc, text in docs:
        kept, all_lines = [], (text or "").split("\n")
        for line in all_lines:
            held = holders.get(key(line), ())
            if len(held) < min_docs or max(held) == rank(doc):
                kept.append(line)
        out.append((doc, len(all_lines), len(all_lines) - len(kept), sha("\n".join(kept))))
    return out


def chats(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for _, _, r, t in turns if r == "assistant")
        out.append((conv, len(turns), sha("".join(f"{r}\n{t}\n" for _, _, r, t in turns)), len(loss), sha(loss)))
    return out


def shingles(text, size=4):
    words = WORD.findall((text or "").translate(LOWER))
    return {tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))} if words else set()


def similar(docs):
    """Size of each document's set, least id of its class, and whether it is that."""
    sets = [frozenset(shingles(text)) for _, text in docs]
    distinct = list(set(sets) - {frozenset()})
    root = {s: s for s in distinct}

    def find(s):
        while root[s] is not s:
            s = root[s]
        return s

    for s, t in combinations(distinct, 2):
        if min(len(s), len(t)) * 100 >= 80 * max(len(s), len(t)) and 100 * len(s & t) >= 80 * len(s | t):
            root[find(s)] = find(t)
    least = {}
    for (doc, _), s in zip(docs, sets, strict=True):
        if s and doc is not None:
            least[find(s)] = min(doc, least.get(find(s), doc))
    out = []
    for (doc, _), s in zip(docs, sets, strict=True):
        component = least.get(find(s)) if s else doc
        out.append((doc, len(s), component, doc == component))
    return out


def phrases(docs, min_count=100, top=2000, most=5):
    """docs: (lang, text)."""
    counts, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(words)
            counts[lang].update(tuple(words[i : i + s]) for s in range(1, most + 1) for i in range(len(words) - s + 1))
    out = []
    for lang, f in counts.items():
        found = {p: a for p, a in f.items() if len(p) > 1 and a >= min_count}
        covered = set()
        for p, a in found.items():
            inner = {p[i : i + s] for s in range(2, len(p)) for i in range(len(p) - s + 1)}
            covered |= {q for q in inner if 100 * a >= 100 * f[q]}
        rows = []
        for p, a in found.items():
            cuts = [(1000 * a * total[lang] // (f[p[:k]] * f[p[k:]]), k) for k in range(1, len(p))]
            score, k = min(cuts)
            if p not in covered:
                rows.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        rows.sort()
        out += [
            (lang, rank, p.decode(), -a, left, right, total[lang], -score)
            for rank, (score, a, p, left, right) in enumerate(rows[:top], 1)
        ]
    return out


def trie(rows):
    by = defaultdict(list)
    for conv, turn, role, text in rows:
        if conv is not None:
            by[conv].append((turn is not None, turn or 0, role or "", text or ""))
    original = {conv: [t[2:] for t in sorted(turns)] for conv, turns in by.items()}
    rebuilt = {}
    for conv, turns in original.items():
        h = zlib.crc32(str(conv).encode()) % 9
        rebuilt[conv] = tuple(original.get(conv - conv % 5, [])[:h] + turns[h:])
    members, children = defaultdict(list), defaultdict(set)
    for conv, turns in rebuilt.items():
        for d in range(len(turns) + 1):
            members[turns[:d]].append(conv)
            if d:
                children[turns[: d - 1]].add(turns[:d])
    leaves, saved = {}, {}
    for node in sorted(members, key=len, reverse=True):
        leaves[node] = sum(leaves[c] for c in children[node]) or 1
        own = (len(members[node]) - 1) * len(node[-1][1].encode()) if node else 0
        saved[node] = own + sum(saved[c] for c in children[node])
    return [
        (
            min(convs), len(node), min(members[node[:-1]]) if node else None, len(convs), len(children[node]), leaves[node],
            saved[node], sha(",".join(str(c) for c in sorted(convs) if len(rebuilt[c]) == len(node))),
        )
        for node, convs in members.items()
    ]
