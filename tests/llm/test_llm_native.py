"""Exact duplicates, shards and mix against plain Python."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from reviewlens.llm import exact_dedup, mixing, sharding

NATIVE = [exact_dedup.membership, lambda d: sharding.shard_documents(d, 8), mixing.taken_words]


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]+", " ", text or "")


def dedup_expected(rows):
    groups = defaultdict(list)
    for doc_id, text in rows:
        groups[normal(text)].append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        known = [i for i in ids if i is not None]
        keep = min(known, default=None)
        digest = hashlib.sha256(text.encode()).hexdigest()
        left = 1
        for i in ids:
            kept = i == keep and left > 0
            left -= kept
            out[(i, keep, len(ids), kept, digest)] += 1
    return out


def test_exact_duplicates(edge, rows):
    got = Counter(tuple(r) for r in exact_dedup.membership(edge).collect())
    assert got == dedup_expected([(r[0], r[1]) for r in rows])


def test_exact_duplicates_without_broadcast(edge, rows, monkeypatch):
    monkeypatch.setattr(exact_dedup, "BROADCAST_BYTES", 0)
    got = Counter(tuple(r) for r in exact_dedup.membership(edge).collect())
    assert got == dedup_expected([(r[0], r[1]) for r in rows])


def test_kept_rows_have_all_columns(edge, rows):
    kept = exact_dedup.deduplicate(edge)
    assert kept.columns == edge.columns
    found = kept.collect()
    assert sorted(normal(r["text"]) for r in found) == sorted({normal(r[1]) for r in rows})
    assert {r["doc_id"] for r in found} >= {0, 3, 6, 8, 9, 10, 12, 13}


def test_only_possible_copies_are_shuffled(documents):
    digests = documents.select(exact_dedup.text_digest().alias("digest"))
    n_bits = exact_dedup._bits(digests.count())
    tested = exact_dedup.possibly_repeated(digests, exact_dedup.repeated_positions(digests, n_bits), n_bits)
    twice = digests.groupBy("digest").count().where("count > 1")
    assert tested.where("not _maybe").join(twice, "digest", "left_semi").count() == 0
    unique = documents.count() - digests.join(twice, "digest", "left_semi").count()
    assert tested.where("not _maybe").count() > 0.9 * unique


def test_shards(edge, rows):
    found = sharding.shard_documents(edge, 8).collect()
    expected = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in found) == expected
    slots = defaultdict(list)
    for r in found:
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    counts = [len(slots[s]) for s in range(8)]
    assert max(counts) - min(counts) <= 1


@pytest.mark.parametrize("slack", [0.0, 0.25])
def test_keys_go_to_their_point_or_clockwise(spark, slack):
    """The rows of every shard are those that a walk round the ring gives, arc by arc."""
    keys = spark.range(3000).withColumnRenamed("id", "key")
    found = sharding.place(keys, "key", 5, slack)
    points = sharding.ring_points(spark, 5)
    arcs = defaultdict(Counter)
    for r in found.withColumn("hash", F.xxhash64("key")).collect():
        arcs[sharding.owner_of(r["hash"], points)][r["shard"]] += 1
    room = sharding.capacities(3000, 5, slack)
    total = Counter()
    for arc, shards in arcs.items():
        total.update(shards)
        if points[arc][1] not in shards:  # only a full shard sends all its keys on
            assert sum(c[points[arc][1]] for c in arcs.values()) == room[points[arc][1]]
    assert all(total[s] <= room[s] for s in range(5))
    at_home = sum(shards[points[arc][1]] for arc, shards in arcs.items())
    assert at_home > (0.8 if slack == 0 else 0.95) * 3000


def test_shards_do_not_depend_on_the_layout(spark, documents, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_BUCKET", 10)
    # A third of all rows are equal, as many again share an id.
    same = documents.limit(1).crossJoin(spark.range(90)).drop("id")
    rows = documents.unionByName(same).unionByName(same.withColumn("text", F.concat("text", F.rand(3).cast("string"))).cache())
    first, second = (
        Counter((r["doc_id"], r["size"], r["text_crc32"], r["shard"]) for r in sharding.shard_documents(df, 8).collect())
        for df in (rows, rows.repartition(7))
    )
    assert first == second and sum(first.values()) == documents.count() + 180


def test_one_more_shard_moves_few_keys(spark):
    keys = spark.range(9_000).withColumnRenamed("id", "key").cache()
    before, after = ({r["key"]: r["shard"] for r in sharding.place(keys, "key", n).collect()} for n in (8, 9))
    moved = [k for k in before if before[k] != after[k]]
    needed = sum(s == 8 for s in after.values())
    assert needed == 1_000 and len(moved) <= 2 * needed


def test_fill_ring_keeps_every_key():
    counts = {0: 10, 1: 0, 2: 500, 3: 7}
    placed = sharding.fill_ring(counts, [0, 1, 2, 1], sharding.capacities(517, 3))
    per_arc = defaultdict(list)
    for arc, first, end, _, _ in placed:
        per_arc[arc].append((first, end))
    for arc, n in counts.items():
        runs = sorted(per_arc.get(arc, []))
        assert [a for a, _ in runs] == [0, *(b for _, b in runs[:-1])][: len(runs)] and (runs[-1][1] if runs else 0) == n


def mix_expected(rows):
    size = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    sizes = defaultdict(int)
    for _, text, source in rows:
        sizes[source] += size(text)
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [s for s in sizes if s is None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    budget, full = 1.5 * sum(sizes.values()), set()
    while True:
        level = (budget - sum(2 * sizes[s] for s in full)) / sum(weight[s] for s in sizes if s not in full)
        more = {s for s in sizes if s not in full and level * weight[s] > 2 * sizes[s]}
        if not more:
            break
        full |= more
    return sizes, {s: 2.0 * sizes[s] if s in full else level * weight[s] for s in sizes}


def test_mix(edge, rows):
    sizes, target = mix_expected([(r[0], r[1], r[3]) for r in rows])
    found = mixing.taken_words(edge).collect()
    assert len(found) == len(rows)
    by_size = defaultdict(set)
    for s in sizes:
        by_size[sizes[s]].add(round(target[s], 6))
    assert all(round(r["target"], 6) in by_size[r["source_size"]] for r in found)
    assert all(0 <= r["taken"] <= 2 * r["size"] for r in found)
    taken = defaultdict(int)
    for r in found:
        taken[(r["source_size"], round(r["target"], 6))] += r["taken"]
    for key, words in taken.items():
        same = sum(1 for s in sizes if (sizes[s], round(target[s], 6)) == key)
        assert abs(words - same * key[1]) <= same
    again = mixing.taken_words(edge.repartition(5)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, found))


def test_schedule_is_even(spark):
    quota = {0: 700, 1: 200, 2: 99, 3: 1}
    slots = mixing.schedule(spark.createDataFrame(list(quota.items()), "code int, quota long")).collect()
    assert Counter(r["code"] for r in slots) == quota
    assert len({r["position"] for r in slots}) == 1000
    order = sorted(slots, key=lambda r: r["position"])
    ranks = defaultdict(list)
    for r in order:
        ranks[r["code"]].append(r["rank"])
    assert all(v == list(range(len(v))) for v in ranks.values())
    for n in (50, 100, 333, 500):
        got = Counter(r["code"] for r in order[:n])
        assert all(abs(got[c] - n * q / 1000) <= 6 for c, q in quota.items())


def test_mixed_documents(edge, rows):
    mixed = mixing.mix_documents(edge)
    assert mixed.columns == edge.columns
    words = defaultdict(int)
    texts = [r[1] or "" for r in rows]
    for r in mixed.collect():
        part = re.findall(r"[^\x20\x09-\x0D]+", r["text"])
        assert any(" ".join(part) in " ".join(re.findall(r"[^\x20\x09-\x0D]+", t)) for t in texts)
        assert r["n_chars"] == len(r["text"])
        words[r["source"]] += len(part)
    _, target = mix_expected([(r[0], r[1], r[3]) for r in rows])
    assert all(abs(words[s] - target[s]) <= 1 for s in target)


def test_every_stretch_of_the_output_is_mixed(spark, documents):
    """Documents come in the order of the schedule: no prefix is far from the shares of the sources."""
    mixed = [(r["source"], r["n"]) for r in mixing.mix_documents(documents).selectExpr("source", "regexp_count(text, '[^ \\t-\\r]+') AS n").collect()]
    total, longest = sum(n for _, n in mixed), max(n for _, n in mixed)
    share = defaultdict(float)
    for source, n in mixed:
        share[source] += n / total
    seen, so_far, worst = Counter(), 0, 0.0
    for source, n in mixed:
        seen[source] += n
        so_far += n
        worst = max(worst, *(abs(seen[s] - share[s] * so_far) for s in share))
    # A document is taken whole at its first slot; blocks are within a few of their place.
    assert worst <= 2 * longest + 8 * mixing.BLOCK_WORDS
    by_source = max(abs(n - share[s] * n) for s, n in Counter({s: round(v * total) for s, v in share.items()}).items())
    assert worst < by_source / 2


def test_positions_follow_the_schedule(documents):
    rows = mixing.taken_words(documents).collect()
    for r in rows:
        assert (r["taken"] == 0) == (r["first_position"] is None) == (r["last_position"] is None)
    big = [r for r in rows if r["taken"] > 3 * mixing.BLOCK_WORDS]
    assert big and all(r["last_position"] > r["first_position"] for r in big)


@pytest.mark.parametrize("operator", NATIVE)
def test_empty_table(empty, operator):
    assert operator(empty).count() == 0


def test_native_plans_have_no_python(edge):
    for operator in NATIVE:
        plan = operator(edge)._jdf.queryExecution().toString()
        assert not re.search("Python|Pandas|Arrow", plan)
