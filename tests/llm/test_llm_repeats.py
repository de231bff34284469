"""Near duplicates and repeated substrings against brute force."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from reviewlens.llm import components, kernels, near_dedup, substring_dedup, suffixes


def shingles(text, n=5):
    words = (text or "").encode().split()
    if not words:
        return Counter()
    return Counter(tuple(words[i : i + n]) for i in range(max(len(words) - n + 1, 1))) if len(words) >= n else Counter([tuple(words)])


def similarity(x, y):
    every = set(x) | set(y)
    return sum(1 / sum(max(x[j] / x[i], y[j] / y[i]) for j in every) for i in set(x) & set(y))


def classes_expected(texts):
    """Smallest position of every class, by pairs that share a shingle."""
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    bags, holders, words = [], defaultdict(set), {}
    for i, text in enumerate(texts):
        bags.append(shingles(text))
        same = words.setdefault(tuple((text or "").encode().split()), i)
        parent[i] = find(same)
        if same == i:
            for s in bags[i]:
                holders[s].add(i)
    seen = set()
    for group in holders.values():
        for i in group:
            for j in group:
                if i < j and (i, j) not in seen:
                    seen.add((i, j))
                    a, b = bags[i], bags[j]
                    if 2 * sum((a & b).values()) >= 0.5 * min(sum(a.values()), sum(b.values())) and similarity(a, b) >= 0.8 - 1e-12:
                        low, high = sorted((find(i), find(j)))
                        parent[high] = low
    return [find(i) for i in range(len(texts))]


def near_expected(rows):
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is None, rows[i][0] or 0))
    rows = [rows[i] for i in order]
    roots = classes_expected([r[1] for r in rows])
    size = Counter(roots)
    out, first = Counter(), set()
    for i, r in enumerate(rows):
        out[(r[0], rows[roots[i]][0], size[roots[i]], roots[i] not in first)] += 1
        first.add(roots[i])
    return out


def test_near_duplicates_of_edge_rows(edge, rows):
    found = Counter(map(tuple, near_dedup.membership(edge).collect()))
    assert found == near_expected([(r[0], r[1]) for r in rows])


def test_near_duplicates_of_documents(documents):
    found = Counter(map(tuple, near_dedup.membership(documents).collect()))
    assert found == near_expected([(r["doc_id"], r["text"]) for r in documents.collect()])


def test_chain_of_near_copies(spark, monkeypatch):
    """A hub with many copies, each unlike the others, and a chain whose ends are unlike, in blocks
    of seven."""
    monkeypatch.setattr(near_dedup, "BLOCK", 7)
    r = random.Random(3)
    base = [f"t{r.randrange(10**6)}" for _ in range(300)]
    texts = [" ".join(base)]
    for k in range(40):
        words = list(base)
        for p in range(4 + k % 9):
            words[(k * 7 + p * 59) % 300] = f"n{k // 2}x{p}"
        texts.append(" ".join(words))
    chain = [f"c{r.randrange(10**6)}" for _ in range(200)]
    for k in range(12):
        texts.append(" ".join(chain))
        chain = chain[15:] + [f"d{k}x{i}" for i in range(15)]
    rows = list(enumerate(texts))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert Counter(map(tuple, near_dedup.membership(df).collect())) == near_expected(rows)


def test_near_dedup_keeps_one_row_per_class(edge, rows, empty):
    kept = near_dedup.deduplicate(edge)
    assert kept.columns == edge.columns
    expected = near_expected([(r[0], r[1]) for r in rows])
    assert Counter(r["doc_id"] for r in kept.collect()) == Counter({k[0]: 0 for k in expected}) + Counter(
        k[0] for k, n in expected.items() for _ in range(n) if k[3]
    )
    assert near_dedup.deduplicate(empty).count() == 0 and near_dedup.membership(empty).count() == 0


def test_registers_agree_as_often_as_the_similarity():
    import pyarrow as pa

    from reviewlens.llm import kernels

    r = random.Random(1)
    left, right = [], []
    for _ in range(60):
        words = [f"v{r.randrange(400)}" for _ in range(r.randint(40, 300))]
        other = list(words)
        for _ in range(r.randint(0, 12)):
            other[r.randrange(len(other))] = "changed"
        left.append(" ".join(words * r.randint(1, 2)))
        right.append(" ".join(other))
    signs = []
    for side in (left, right):
        texts = kernels.Texts(pa.array(side))
        owner, hashes, weight, _ = near_dedup.bags(texts)
        signs.append(near_dedup.signatures(owner, hashes, weight, texts.n))
    exact = np.array([similarity(shingles(a), shingles(b)) for a, b in zip(left, right, strict=True)])
    error = (signs[0] == signs[1]).mean(axis=1) - exact
    assert abs(error.mean()) < 0.02 and np.abs(error).max() < 0.2


def test_components(spark):
    r = random.Random(2)
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(r.randrange(200, 300), r.randrange(200, 300)) for _ in range(60)]
    parent = {x: x for p in pairs for x in p}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a, b in pairs:
        low, high = sorted((find(a), find(b)))
        parent[high] = low
    found = dict(map(tuple, components.components(spark.createDataFrame(pairs, "a long, b long")).collect()))
    assert all(found.get(x, x) == find(x) for x in parent)
    assert components.components(spark.createDataFrame([], "a long, b long")).count() == 0


def removal_expected(texts, length):
    count = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        covered = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if count[t[i : i + length]] > 1:
                covered[i : i + length] = b"\1" * length
        left = bytes(b for b, c in zip(t, covered, strict=True) if not c)
        spans = sum(1 for i, c in enumerate(covered) if c and not (i and covered[i - 1]))
        out.append((len(t), sum(covered), spans, hashlib.sha256(left).hexdigest()))
    return out


@pytest.mark.parametrize("runs_per_anchor", [substring_dedup.RUNS_PER_ANCHOR, 2])
def test_removed_bytes(edge, rows, documents, runs_per_anchor):
    short = [(r[0], (r[1] or "")[:30_000]) for r in rows]
    for df, data in ((edge.selectExpr("doc_id", "left(text, 30000) AS text", "row", "span"), short), (documents, [(r["doc_id"], r["text"]) for r in documents.collect()])):
        found = Counter(map(tuple, substring_dedup.remove_repeats(df, runs_per_anchor=runs_per_anchor).collect()))
        expected = removal_expected([(t or "").encode() for _, t in data], substring_dedup.LENGTH)
        assert found == Counter((d, *e) for (d, _), e in zip(data, expected, strict=True))


def test_removed_bytes_of_periodic_and_cut_texts(spark, monkeypatch):
    monkeypatch.setattr(substring_dedup, "SEGMENT", 1000)
    texts = ["ab" * 400, "x" * 150, "x" * 260, "y" * 20 + "ab" * 90 + "é" * 130, "é" * 100, "q" + "é" * 100, ""]
    r = random.Random(9)
    passage = "".join(r.choice("abcdefgh ") for _ in range(350))
    texts += ["".join(r.choice("xyz") for _ in range(r.randrange(30))) + passage[a : a + 250] + str(a) for a in range(0, 100, 9)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = sorted(map(tuple, substring_dedup.remove_repeats(df).collect()))
    assert found == [(i, *e) for i, e in enumerate(removal_expected([t.encode() for t in texts], 200))]
    left = {r["doc_id"]: r["text"] for r in substring_dedup.remove_repeats(df, texts=True).collect()}
    assert left[6] == "" and left[1] == "x" * 150


def test_long_text_behind_a_short_one_is_cut(monkeypatch):
    r = random.Random(4)
    texts = ["short one", "".join(r.choice("ab ") for _ in range(5_000)), "x" * 300, None, "y" * 1_000]
    batch = pa.RecordBatch.from_arrays([pa.array(range(5), pa.int64()), pa.array(texts)], ["row", "text"])
    assert [rows.num_rows for rows, _ in kernels.chunks(batch, "text", 1_000)] == [1, 1, 3]
    seen, anchor_runs = [], substring_dedup.anchor_runs
    monkeypatch.setattr(substring_dedup, "anchor_runs", lambda t, n: seen.append(len(t.data)) or anchor_runs(t, n))
    starts = Counter()
    for part in substring_dedup._runs(200, 1_000)(iter([batch])):
        for row, span in zip(part["row"].to_pylist(), part["span"].to_pylist()):
            starts.update((row, (span >> 16) + i) for i in range(span & 0xFFFF))
    assert starts == Counter((i, at) for i, t in enumerate(texts) for at in range(len(t or "") - 199))
    assert max(seen) <= 1_300
    monkeypatch.setattr(substring_dedup, "_PLACE_BITS", 10)
    with pytest.raises(ValueError, match="10 bits"):
        anchor_runs(kernels.Texts(pa.array(["a" * 1_025])), 200)


def test_removal_of_empty_table(empty):
    assert substring_dedup.remove_repeats(empty).count() == 0


def test_suffix_blocks():
    r = random.Random(5)
    for _ in range(150):
        length = r.choice([1, 2, 3, 5, 8, 15])
        alphabet = r.choice([b"ab", b"abc", b"abcdefgh", b"\x00\xff"])
        base = bytes(r.choice(alphabet) for _ in range(60))
        strings = []
        for _ in range(r.randint(1, 8)):
            i = r.randrange(50)
            strings.append(bytes(r.choice(alphabet) for _ in range(r.randint(0, 10))) + base[i : i + r.randint(0, 40)])
        copies = np.array([r.choice([1, 1, 2]) for _ in strings])
        count = Counter()
        for s, n in zip(strings, copies, strict=True):
            for i in range(len(s) - length + 1):
                count[s[i : i + length]] += n
        expected = [[i for i in range(len(s) - length + 1) if count[s[i : i + length]] > 1] for s in strings]
        assert [v.tolist() for v in suffixes.repeated_starts(strings, copies, length)] == expected
