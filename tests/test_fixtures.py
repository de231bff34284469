"""Operators on small hand-made rows."""

import math
import sys
from datetime import datetime

import numpy as np
import pytest
from pyspark.sql import functions as F

from reviewlens import dims
from reviewlens.functions import arrays as a
from reviewlens.functions import columns as c
from reviewlens.functions import text as x
from reviewlens.operators import clean, nested, ordering, pages, sentiment, sizes, stats, textprep, topics
from reviewlens.plans import reports, stages
from reviewlens.sources import files


def one(spark, column, schema="x int", row=(0,)):
    return spark.createDataFrame([row], schema).select(column).first()[0]


def values(df, *columns):
    return [tuple(r) for r in df.select(*columns).collect()]


# --- numbers, flags, labels -----------------------------------------------------------------------------


def test_blank_to_double(spark):
    df = spark.createDataFrame([(" ",), ("4.5",), (None,), ("nan",), ("x",)], "v string")
    assert [r[0] for r in df.select(c.to_double("v")).collect()] == [None, 4.5, None, None, None]


def test_row_means_differ_on_missing(spark):
    schema, row = "a double, b double, c double", (4.0, None, 2.0)
    assert one(spark, c.row_mean("a", "b", "c"), schema, row) == 3.0
    assert one(spark, c.row_mean_strict("a", "b", "c"), schema, row) is None


def test_text_to_bool(spark):
    df = spark.createDataFrame([("True",), ("False",), (" ",), ("yes",)], "v string")
    assert [r[0] for r in df.select(c.text_to_bool("v")).collect()] == [True, False, None, None]


def test_parse_posted(spark):
    df = spark.createDataFrame([("3/4/2019 1:05:09 PM",), (" ",), ("13/45/2019 1:05:09 PM",)], "v string")
    assert [r[0] for r in df.select(c.parse_posted("v")).collect()] == [datetime(2019, 3, 4, 13, 5, 9), None, None]


def test_names_follow_dictionary_order(spark):
    df = spark.createDataFrame([("xabz",), ("q",)], "v string")
    assert [r[0] for r in df.select(c.simplify_name("v", ["ab", "xab"])).collect()] == ["ab", "q"]
    dictionary = dims.dictionary_table(spark, {"f": ["ab", "xab"]})
    matched = clean.first_match_join(df, "v", dictionary).orderBy("v")
    assert values(matched, "v", "matched_name") == [("q", None), ("xabz", "ab")]


def test_backfill_name(spark):
    df = spark.createDataFrame([(None, "zoloft sertraline"), (" ", "other"), ("x", "sertraline")], "g string, d string")
    assert [r[0] for r in df.select(c.backfill_name("g", "d", ["sertraline"])).collect()] == ["zoloft sertraline", " ", "x"]


def test_drug_dictionary():
    assert len(dims.drug_names()) == 43 and len(dims.DRUG_FAMILIES) == 8
    assert dims.drug_names().index("citalopram") < dims.drug_names().index("escitalopram")


def test_labels(spark):
    df = spark.createDataFrame([("0-2",), ("25-34",), (None,)], "v string")
    label = c.with_suffix(c.remap("v", dims.AGE_REMAP), dims.AGE_SUFFIX)
    assert [r[0] for r in df.select(label).collect()] == ["00-02 yrs", "25-34 yrs", None]


def test_band3(spark):
    df = spark.createDataFrame([(2.5,), (2.6,), (4.0,), (None,), (math.nan,)], "v double")
    bands = [r[0] for r in df.select(c.band3("v", 2.5, 4.0)).collect()]
    assert bands == ["negative", "neutral", "positive", "neutral", "neutral"]


def test_posted_parts(spark):
    parts = c.posted_parts(F.lit(1546300800000))
    row = spark.range(1).select(*[v.alias(k) for k, v in parts.items()]).first()
    assert tuple(row) == (datetime(2019, 1, 1), 2019, 1, "2019-1")


def test_word_count_and_truncation(spark):
    df = spark.createDataFrame([("",), (" a  b ",), ("a b c",)], "v string")
    assert [r[0] for r in df.select(x.word_count("v")).collect()] == [0, 2, 3]
    label = "a" * 25
    assert one(spark, c.truncate_label(F.lit(label), 20, 28)) == label + "..."


def test_round_half_even(spark):
    assert one(spark, c.round_half_even(F.lit(0.125))) == 0.12
    assert one(spark, c.round_half_even(F.lit(2.5), 0)) == 2.0


def test_softmax(spark):
    zero = F.lit(0.0)
    assert [one(spark, s) for s in c.softmax(zero, zero, zero)] == pytest.approx([1 / 3] * 3)


# --- nested ---------------------------------------------------------------------------------------------


REVIEW = "array<struct<Comment: string, v: double>>"


def test_elements(spark):
    rows = [([("", 3.0), ("ab", None), ("abc", 5.0)],), ([("abcd", None)],), ([],)]
    df = spark.createDataFrame(rows, f"r {REVIEW}")
    assert [r[0] for r in df.select(F.size(a.longer_than("r", "Comment", 2))).collect()] == [1, 1, 0]
    assert [r[0] for r in df.select(a.field_mean("r", "v")).collect()] == [4.0, None, None]


def test_within(spark):
    df = spark.createDataFrame([([("", -1.0), ("", 1.0), ("", 1.01), ("", None), ("", math.nan)],)], f"r {REVIEW}")
    assert [e.v for e in df.select(a.within("r", "v", -1, 1)).first()[0]] == [-1.0, 1.0]


def test_expand_keeps_empty_lists(spark):
    df = spark.createDataFrame([(1, []), (2, [("a", 1.0)])], f"k int, Reviews {REVIEW}")
    assert sorted(values(nested.expand_reviews(df), "k", "Comment"), key=str) == [(1, None), (2, "a")]


def test_long_lists_are_split_and_whole(spark):
    df = spark.range(1000).select(F.when(F.col("id") < 700, "hot").otherwise(F.concat(F.lit("k"), F.col("id") % 30)).alias("k"), "id")
    lists = nested.nest_reviews(df, ["k"], ["id"], ["id"], max_elements=100)
    assert lists.where("k = 'hot'").count() == 7
    hot = [e["id"] for r in lists.where("k = 'hot'").orderBy("part").collect() for e in r["Reviews"]]
    assert hot == list(range(700))
    assert lists.where("k <> 'hot'").count() == 30
    assert lists.agg(F.max(F.size("Reviews"))).first()[0] <= 100
    back = nested.expand_reviews(lists)
    assert back.select("k", "id").exceptAll(df).count() == 0 and back.count() == 1000
    ordered = F.expr("Reviews = array_sort(Reviews)")
    assert lists.where(~ordered).count() == 0


def test_multi_topic_and_names(spark):
    df = spark.createDataFrame([(1, [0.1, 0.01, 0.6]), (2, [0.01, 0.02, 0.03])], "k int, TopicProbability array<double>")
    listed = topics.add_topic_list(df)
    assert [r[0] for r in listed.select("TopicsList").collect()] == [[0, 2], []]
    names = spark.createDataFrame([(0, "n0")], "topic int, name string")
    assert [r[0] for r in topics.add_topic_names(listed, "k", "TopicsList", names).select("TopicNames").collect()] == [["n0"], []]


def test_topic_names_by_join(spark, monkeypatch):
    monkeypatch.setattr(sizes, "LEVELS", 1)
    df = spark.createDataFrame([(1, [2, 0, 9]), (2, [])], "k int, ids array<int>")
    names = spark.createDataFrame([(0, "n0"), (2, "n2")], "topic int, name string")
    named = topics.add_topic_names(df, "k", "ids", names).orderBy("k")
    assert [r[0] for r in named.select("TopicNames").collect()] == [["n2", "n0"], []]


# --- rows -----------------------------------------------------------------------------------------------


def test_dedupe_first(spark):
    df = spark.createDataFrame([(1, "a", None), (2, "a", None), (3, "b", "x"), (4, "b", "x")], "seq int, k string, g string")
    assert sorted(values(clean.dedupe_first(df, ["k", "g"], "seq"), "seq")) == [(1,), (3,)]


def test_drop_incomplete(spark):
    rows = [(1, "a", [1], True), (0, "a", [1], True), (1, "", [1], True), (1, "a", [], True), (1, "a", [1], False), (None, "a", [1], True)]
    df = spark.createDataFrame(rows, "n int, s string, l array<int>, b boolean")
    assert clean.drop_incomplete(df).count() == 1


def test_choose(spark):
    df = spark.createDataFrame([("a", "Male"), ("b", "Female"), ("b", None)], "f string, Gender string")
    assert clean.choose(df, always=("Gender",), f="All", Gender=["Male", "Female"]).count() == 2
    assert clean.choose(df, always=("Gender",), f=["b"], Gender=["Male", "Female", "All"]).count() == 1
    assert clean.choose(df, f="All").count() == 3


def test_ordered_counts(spark):
    df = spark.createDataFrame([("a",), ("a",), ("zz",)], "v string")
    assert values(stats.ordered_counts(df, "v", dims.ordered_labels(spark, ["a", "b"])), "label", "n") == [("a", 2), ("b", 0)]


def test_top_and_other(spark):
    rows = [(f"label {i:02d}",) for i in range(22) for _ in range(30 - i)]
    table = dict(values(stats.top_and_other(spark.createDataFrame(rows, "v string"), "v"), "label", "n"))
    assert len(table) == 21 and table["Other"] == 10 + 9
    few = dict(values(stats.top_and_other(spark.createDataFrame([("a",), (None,)], "v string"), "v"), "label", "n"))
    assert few == {"a": 1}


def test_describe(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (4.0,), (8.0,), (None,)], "v double")
    assert dict(values(stats.describe_ratings(df, ["v"]), "Statistic", "v")) == {"mean": 3.75, "25%": 1.75, "50%": 3.0, "75%": 5.0}


def test_topic_shares_use_group_rows(spark):
    df = spark.createDataFrame([("g", ["t1", "t2"]), ("g", [])], "g string, t array<string>")
    assert values(stats.share_by_group(df, "g", "t"), "item", "share") == [("t1", 0.5), ("t2", 0.5)]


def test_constant_side_has_no_correlation(spark):
    df = spark.createDataFrame([("a", [0.1, 0.3]), ("a", [0.1, 0.5])], "g string, p array<double>")
    assert {r.correlation for r in stats.topic_group_correlation(df, "p", "g").collect()} == {None}
    df = spark.createDataFrame([("a", [0.1, 0.3]), ("b", [0.1, 0.5])], "g string, p array<double>")
    got = {(r.topic, r.level): r.correlation for r in stats.topic_group_correlation(df, "p", "g").collect()}
    assert got[(0, "a")] is None and got[(1, "b")] == pytest.approx(1.0) and got[(1, "a")] == pytest.approx(-1.0)


def test_positions_over_many_ranges(spark):
    df = spark.range(5000).select(F.pmod(F.xxhash64("id"), F.lit(3000)).alias("v"))
    got = ordering.value_positions(df, "v", ranges=16).orderBy("v").toPandas()
    data = sorted(r[0] for r in df.collect())
    distinct = sorted(set(data))
    assert got["v"].tolist() == distinct
    assert got["values_before"].tolist() == list(range(len(distinct)))
    counts = {v: data.count(v) for v in distinct[:50]}
    assert got["n"].tolist()[:50] == [counts[v] for v in distinct[:50]]
    assert got["rows_before"].tolist() == [int(np.searchsorted(data, v)) for v in distinct]


def test_spearman_with_a_heavy_tie(spark):
    rng = np.random.default_rng(1)
    left = np.where(rng.random(600) < 0.4, 7, rng.integers(0, 50, 600))
    right = left * 2 + rng.integers(0, 30, 600)
    import pandas as pd

    frame = pd.DataFrame({"a": left, "b": right})
    expected = frame["a"].rank().corr(frame["b"].rank())
    assert stats.spearman(spark.createDataFrame(frame), "a", "b").first()[0] == pytest.approx(expected)


# --- pages ----------------------------------------------------------------------------------------------


def test_resolve(spark):
    base = "http://a.b/c/d?x=1"
    hrefs = ["/e", "e", "http://z/", "//y/q", "?k=2", "#top"]
    df = spark.createDataFrame([(h,) for h in hrefs], "h string")
    got = [r[0] for r in df.select(pages.resolve(F.lit(base), "h")).collect()]
    assert got == ["http://a.b/e", "http://a.b/c/e", "http://z/", "http://y/q", "http://a.b/c/d?k=2", "http://a.b/c/d?x=1#top"]


def test_xml_reviews_are_padded_and_do_not_shift(spark):
    xml = (
        "<feed><review><userreviewid>1</userreviewid><lookuptext1>25-34</lookuptext1><userexperience>fine</userexperience></review>"
        "<review><userreviewid>2</userreviewid><userexperience>bad</userexperience></review></feed>"
    )
    got = spark.range(1).select(pages.xml_reviews(F.lit(xml), F.lit(3))).first()[0]
    assert [(r.Id, r.Age, r.Comment) for r in got] == [("1", "25-34", "fine"), ("2", None, "bad"), (None, None, None)]


def test_unescape(spark):
    text = "a &amp;lt; b &lt;i&gt; &#39;x&#39; &#x2019; &eacute;<![CDATA[ok]]>"
    assert one(spark, pages.unescape(F.lit(text))) == "a &lt; b <i> 'x' ’ éok"


def test_section_by_class(spark):
    html = '<div class="x uses y"><p>one</p> two</div><div class="other">three</div>'
    assert one(spark, pages.section_text(F.lit(html), "div", "uses")) == "one two"


def test_decode_records(spark):
    schema = "array<struct<Id: string, C: string, ok: boolean>>"
    rows = [
        """[{'Id':'1','C':"it's", 'ok': True}]""",
        """[{'Id':'1','C': None, 'ok': False}]""",
        """[{'Id':'None','C': "a: None, b: True", 'ok': None}]""",
        """[{"Id": "7", "C": "plain json", "ok": true}]""",
    ]
    df = spark.createDataFrame([(r,) for r in rows], "t string")
    got = [tuple(r[0][0]) for r in df.select(files.decode_records("t", schema)).collect()]
    assert got == [("1", "it's", True), ("1", None, False), ("None", "a: None, b: True", None), ("7", "plain json", True)]


# --- text -----------------------------------------------------------------------------------------------


def merge_by_hand(tokens, phrases):
    out, i = [], 0
    while i < len(tokens):
        if i + 1 < len(tokens) and (tokens[i], tokens[i + 1]) in phrases:
            out.append(f"{tokens[i]}_{tokens[i + 1]}")
            i += 2
        else:
            out.append(tokens[i])
            i += 1
    return out


def test_phrase_merge_is_greedy(spark):
    rng = np.random.default_rng(3)
    docs = [(i, [str(t) for t in rng.choice(list("abc"), rng.integers(0, 12))]) for i in range(300)]
    docs.append((300, ["a", "b", "a"]))
    phrases = {("a", "b"), ("b", "a"), ("c", "c")}
    df = spark.createDataFrame(docs, "k int, t array<string>")
    table = spark.createDataFrame(list(phrases), "a string, b string")
    got = {r.k: r.t for r in textprep.merge_phrases(df, "k", "t", table).collect()}
    assert got == {k: merge_by_hand(t, phrases) for k, t in docs}
    assert got[300] == ["a_b", "a"]


def test_phrases_are_merged_without_a_shuffle(spark, monkeypatch):
    phrases = {("a", "b"), ("b", "a"), ("c", "c")}
    docs = [(1, ["a", "b"]), (1, ["b", "c", "c", "c"]), (1, ["a", "b"]), (2, ["c"]), (2, []), (3, None), (None, ["a", "b", "a", "b"])]
    df, table = spark.createDataFrame(docs, "k int, t array<string>"), spark.createDataFrame(list(phrases), "a string, b string")
    expected = sorted((k, None if t is None else merge_by_hand(t, phrases)) for k, t in docs if k) + [(None, ["a_b", "a_b"])]
    by_key = lambda r: (r[0] is None, r[0] or 0, r[1] is not None, r[1] or [])
    merged = textprep.merge_phrases(df, "k", "t", table)
    assert "Exchange" not in merged._jdf.queryExecution().executedPlan().toString()
    assert sorted(values(merged, "k", "t"), key=by_key) == sorted(expected, key=by_key)
    monkeypatch.setattr(textprep, "PHRASES_SENT", 2)
    assert sorted(values(textprep.merge_phrases(df, "k", "t", table), "k", "t"), key=by_key) == sorted(expected, key=by_key)


def test_rare_and_unlisted_words_are_counted(spark, monkeypatch):
    rows = [(["a", "b", "x%d" % i, "a", "b"],) for i in range(8)] + [(["b", "a"],), ([],), (None,)]
    df = spark.createDataFrame(rows, "t array<string>")
    everything = sorted(values(textprep.learn_phrases(df, "t", 2, 0.0), "a", "b", "n", "score"))
    # 10 words; a-b, b-a, eight b-x and eight x-a are 18 pairs.
    assert everything == [("a", "b", 16, 14 * 28 / (17 * 17))]
    monkeypatch.setattr(textprep, "WORDS_SENT", 1)
    monkeypatch.setattr(textprep, "PAIRS_HELD", 1)
    assert sorted(values(textprep.learn_phrases(df, "t", 2, 0.0), "a", "b", "n", "score")) == everything


def test_short_and_long_word_tables_give_the_same(spark, monkeypatch):
    docs = spark.createDataFrame(
        [(1, "The doctors felt better, 3 days!"), (2, ""), (3, "the the"), (4, None), (4, "felt\xa0days felt"), (4, "better")], "k int, c string"
    )
    words = spark.createDataFrame([("the",), ("days",)], "word string")
    lemmas = dims.lemma_table(spark)
    short = textprep.clean_texts(docs, "k", "c", "t", words)
    short = values(textprep.lemmatize_texts(short, "k", "t", "l", lemmas).orderBy("k", "c"), "k", "t", "l")
    monkeypatch.setattr(textprep, "DRUG_NAME_LIMIT", 1)
    monkeypatch.setattr(textprep, "LEMMA_LIMIT", 1)
    long = textprep.clean_texts(docs, "k", "c", "t", words)
    long = values(textprep.lemmatize_texts(long, "k", "t", "l", lemmas).orderBy("k", "c"), "k", "t", "l")
    assert short == long == [
        (1, "doctors felt better", "doctor feel good"), (2, "", ""), (3, "", ""),
        (4, None, None), (4, "better", "good"), (4, "felt felt", "feel feel"),
    ]


def test_lexicon_rules(spark):
    texts = {
        "plain": "a good day", "none": "a day", "negated": "not a good day", "boosted": "a very good day",
        "caps": "a GOOD day", "shout": "a good day!!!", "but": "good but awful", "empty": "",
    }
    df = spark.createDataFrame(list(texts.items()), "k string, c string")
    scored = sentiment.add_lexicon_scores(df, "c", dims.word_weights(spark, dims.LEXICON))
    got = {r.k: r for r in scored.collect()}
    norm = lambda s: round(s / math.sqrt(s * s + 15), 4)
    assert got["plain"].vader_compound == norm(1.9)
    assert got["none"].vader_compound == 0 and got["none"].vader_neu == 1
    assert got["negated"].vader_compound == norm(1.9 * -0.74)
    assert got["boosted"].vader_compound == norm(1.9 + 0.293)
    assert got["caps"].vader_compound == norm(1.9 + 0.733)
    assert got["shout"].vader_compound == norm(1.9 + 3 * 0.292)
    assert got["but"].vader_compound == norm(1.9 * 0.5 - 2.0 * 1.5)
    assert (got["empty"].vader_neg, got["empty"].vader_neu, got["empty"].vader_pos) == (0, 0, 0)


def test_straight_line_is_found(spark):
    df = spark.range(200).select("id", (F.col("id") / 100 - 1).alias("s")).withColumn("y", 1 + 2 * F.col("s"))
    model, error = sentiment.fit_rating_model(df, "s", "y", "id")
    predicted = df.select(sentiment.predict_rating("s", sentiment.coefficients(model)).alias("p"), "y")
    assert predicted.select(F.max(F.abs(F.col("p") - F.col("y")))).first()[0] < 1e-6
    assert error["rmse"] < 1e-6


# --- topics and plans -----------------------------------------------------------------------------------


def test_topic_model_round_trip(spark, tmp_path):
    rng = np.random.default_rng(5)
    points = [(i, (rng.normal(size=4) * 0.1 + (i % 3) * 2).tolist()) for i in range(90)]
    df = spark.createDataFrame(points, "k int, v array<double>")
    model = topics.fit_topics(df, "v", 3)
    topics.save_topic_model(spark, model, str(tmp_path / "m"))
    loaded = topics.load_topic_model(spark, str(tmp_path / "m"))
    first, second = (topics.assign_topics(df, "v", m).orderBy("k").collect() for m in (model, loaded))
    assert first == second
    assert all(sum(r.TopicProbability) == pytest.approx(1.0) for r in first)
    assert len({r.Topic for r in first if r.Topic >= 0}) == 3


def test_words_of_one_bucket_are_apart(spark):
    """Two groups of comments whose words meet in the same 256 hash buckets are two topics."""
    from pyspark.ml.feature import HashingTF

    index, found = HashingTF(numFeatures=256).indexOf, {}
    for i in range(4_000):
        found.setdefault(index(f"w{i}"), []).append(f"w{i}")
    pairs = [words[:2] for words in list(found.values())[:12]]
    rows = [(i, " ".join(pairs[(i // 2 + j) % 12][i % 2] for j in range(6))) for i in range(96)]
    modelled, model = stages.model_segment(spark.createDataFrame(rows, "Id int, cleaned_Comment string"), 2, None)
    topic = {r["Id"]: r["Topic"] for r in modelled.collect()}
    assert len(topic) == 96 and {topic[i] for i in range(0, 96, 2)} != {topic[i] for i in range(1, 96, 2)}
    assert all(topic[i] in (topic[i % 2], topics.OUTLIER) for i in range(96))
    assert model.centres.shape[1] > 24


@pytest.mark.parametrize("comments", [["same words here"] * 5, ["one comment"], [None, "", None], [None, "pain relief", "pain", "relief pain", ""]])
def test_segment_without_usual_terms(spark, comments):
    df = spark.createDataFrame(list(enumerate(comments)), "Id int, cleaned_Comment string")
    for merge_at in (None, 0.9):
        rows = stages.model_segment(df, 3, merge_at)[0].collect()
        assert sorted(r["Id"] for r in rows) == list(range(len(comments)))
        assert all(sum(r["TopicProbability"]) == pytest.approx(1.0) for r in rows)


def test_rows_without_segment_are_returned(spark, tmp_path):
    rows = [(i, "en", f"pain relief w{i % 3}") for i in range(12)] + [(12, None, "pain"), (13, "", "relief"), (14, None, None)]
    df = spark.createDataFrame(rows, "Id int, family string, cleaned_Comment string")
    found = stages.model_segments(df, str(tmp_path / "a"), ("family",), topic_count=2).collect()
    assert sorted((r["Id"], r["family"] or "", r["family"] is None) for r in found) == [(i, f or "", f is None) for i, f, _ in rows]
    assert all((r["Topic"] is None) == (r["TopicProbability"] is None) == (not r["family"]) for r in found)
    alone = stages.model_segments(df.where("Id > 11"), str(tmp_path / "b"), ("family",), topic_count=2)
    assert sorted(alone.columns) == sorted(found[0].asDict()) and alone.where("Topic IS NULL").count() == 3


def test_axes_of_many_dimensions(spark):
    rng = np.random.default_rng(3)
    x = (rng.random((120, 1_500)) < 0.02) * rng.random((120, 1_500))
    x[:, :40] += np.outer(np.arange(120) % 2, np.ones(40)) * 2
    x[:, 40:60] += np.outer(np.arange(120) % 3 == 0, np.ones(20)) * 2
    from pyspark.ml.linalg import Vectors

    rows = [(i, Vectors.sparse(1_500, {int(j): float(v[j]) for j in np.flatnonzero(v)})) for i, v in enumerate(x)]
    sparse = spark.createDataFrame([*rows, (120, None)], ["k", "v"]).repartition(5)
    dense = spark.createDataFrame([*((i, v.tolist()) for i, v in enumerate(x)), (120, None)], "k long, v array<double>")
    axes = topics.principal_axes(sparse.dropna().select(F.col("v").alias("features")), 1_500)
    expected = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)[2][:2].T
    assert np.abs((axes * expected).sum(axis=0)) == pytest.approx([1, 1], abs=1e-3)
    model = topics.TopicModel(x[:4], 0.7, 1e9, axes)
    first, second = (topics.assign_topics(df, "v", model).drop("v").orderBy("k").collect() for df in (sparse, dense))
    for one_row, other, v in zip(first, second, [*x, None]):
        if v is None:
            assert one_row.asDict() == other.asDict() == {"k": 120, "Topic": None, "TopicProbability": None, "UMAP_x": None, "UMAP_y": None}
            continue
        weights = np.exp(-((v - x[:4]) ** 2).sum(axis=1) / 0.7 + ((v - x[:4]) ** 2).sum(axis=1).min() / 0.7)
        for row in (one_row, other):
            assert row["TopicProbability"] == pytest.approx(weights / weights.sum(), abs=1e-9)
            assert (row["UMAP_x"], row["UMAP_y"]) == pytest.approx(tuple(v @ axes))


def test_merged_topics_agree(spark):
    centres = np.array([[1, 0, 0], [0.99, 0.1, 0], [0, 1, 0], [0, 0.99, 0.1], [0, 0, 1.0]])
    table = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(centres)], "topic int, vector array<double>")
    model = topics.TopicModel(centres, 1.0, 1.0, np.zeros((3, 2)))
    expected = {0: 0, 1: 0, 2: 2, 3: 2, 4: 4}
    assert topics.merge_table(topics.reduce_topics(table, 0.9)) == expected == topics.merged_topics(model, 0.9)


def test_stage1_round_trip(spark, tmp_path):
    record = {f: "text" for f in files.RECORD_FIELDS if f != "Reviews"}
    record.update(Drug="sertraline oral", GenName=" ", DrugId="7", NumReviews="2", Effectiveness="4", EaseofUse="3", Satisfaction=" ")
    review = {f: " " for f in files.REVIEW_FIELDS}
    review.update(Id="1", IsMale="True", Age="0-2", Comment="it helped", Effectiveness="4", EaseOfUse="5", Satisfaction="3")
    short = dict(review, Id="2", Comment="ok")
    complete = dict(record, Satisfaction="5")
    repeated = dict(complete, Condition="another")
    other = dict(complete, Drug="aspirin", GenName="aspirin", DrugId="8")

    import json

    path = tmp_path / "records.json"
    lines = [dict(r, Reviews=[review, short]) for r in (record | {"DrugId": "9"}, complete, repeated, other)]
    path.write_text("\n".join(json.dumps(r) for r in lines))
    tables = stages.stage1(stages.read_records(spark, str(path)))
    drug = tables.drugs.collect()
    assert [(d.DrugId, d.GenName, d.DrugFamily, d.DrugCondition, d.ScrapedReviews, d.MeanOverall) for d in drug] == [
        ("7", "sertraline", "SSRI", "text", 1, 4.0)
    ]
    reviews = tables.reviews.collect()
    assert [(r.Id, r.Age, r.IsMale, r.IsPatient, r.Overall) for r in reviews] == [("1", "00-02 yrs", True, None, 4.0)]
    assert stages.nested_records(tables).select(F.size("Reviews")).first()[0] == 1


def test_lists_are_joined_where_they_lie(spark):
    rows = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (2, 3, "c")], "k int, o int, v string")
    lists = nested.nest_reviews(rows, ["k"], ["o"], ["v", "o"])
    assert sorted(values(lists, "k", "part", "Reviews")) == [(1, 0, [("a", 1), ("b", 2)]), (2, 0, [("c", 3)])]
    names = spark.createDataFrame([(1, "x"), (2, "y")], "k int, name string")
    plan = lists.join(names.hint("shuffle_hash"), "k")._jdf.queryExecution().executedPlan().toString()
    # The rows once and the names once: the lists are not sent again.
    assert plan.count("Exchange hashpartitioning") == 2


def test_stage1_joins_many_drugs_without_a_sort_of_the_lists(spark, tmp_path, monkeypatch):
    record = {f: "5" for f in files.RECORD_FIELDS if f != "Reviews"}
    review = dict.fromkeys(files.REVIEW_FIELDS, "4") | {"Comment": "it helped"}
    some = [dict(record, Drug="sertraline oral", GenName=n, DrugId=str(i), Reviews=[dict(review, Id=str(i))]) for i, n in enumerate(["sertraline", " ", "none"])]
    import json

    (tmp_path / "records.json").write_text("\n".join(json.dumps(r) for r in some))
    records = stages.read_records(spark, str(tmp_path / "records.json"))
    few = sorted(values(stages.stage1(records).reviews, "Id", "DrugId", "GenName", "Drug", "Overall"))
    assert few == [(str(i), str(i), "sertraline", "sertraline oral", 4.0) for i in (0, 1)]
    monkeypatch.setattr(sizes, "BROADCAST_ROWS", 0)
    many = stages.stage1(records).reviews
    assert "ShuffledHashJoin" in plan_of(many)
    assert sorted(values(many, "Id", "DrugId", "GenName", "Drug", "Overall")) == few


def test_overview_filters_gender(spark):
    rows = [("F", g, "00-02 yrs", "10 years or more", "c", 3.0, "a b c", "neutral") for g in ("Male", "Female", None)]
    df = spark.createDataFrame(rows, "DrugFamily string, Gender string, Age string, TimeUsingDrug string, Condition string, "
                               "Overall double, Comment string, bert_compound_threshold string")
    df = df.withColumns({r: F.col("Overall") for r in dims.RATINGS[:3]})
    tables = reports.overview(df)
    assert dict(values(tables["genders"], "label", "n")) == {"Male": 1, "Female": 1}
    assert sum(n for (n,) in values(tables["ages"], "n")) == 2
    assert values(tables["times"], "n")[-1] == (2,)


# --- plans of the physical kind ----------------------------------------------------------------------------


def plan_of(df):
    return df._jdf.queryExecution().toString()


def test_segment_read_prunes(spark, tmp_path):
    df = spark.range(10).select("id", (F.col("id") % 2).cast("string").alias("DrugFamily"), F.lit("positive").alias("bert_compound_threshold"))
    files.write_segments(df, str(tmp_path / "s"))
    part = files.read_segment(spark, str(tmp_path / "s"), df.schema, DrugFamily="1", bert_compound_threshold="positive")
    assert part.count() == 5
    assert "PartitionFilters: [isnotnull" in plan_of(part)


def test_built_in_plans(spark, data):
    import __spark_entry__ as entry_point

    queries = entry_point.queries()
    for name in ("lexicon_sentiment", "clean_text", "phrase_bigrams", "topic_terms", "report_sentiment", "corr_topic_group", "dedupe_first"):
        plan = plan_of(queries[name](spark, data))
        assert "EvalPython" not in plan and "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
    assert "Exchange hashpartitioning" not in plan_of(queries["lexicon_sentiment"](spark, data))


def test_ngrams_of_frequent_words_are_all_ngrams(spark, monkeypatch):
    rng = np.random.default_rng(8)
    docs = [(i, [str(t) for t in rng.choice(list("abcdefghij"), rng.integers(0, 9))]) for i in range(60)]
    df = spark.createDataFrame(docs, "k int, t array<string>")

    def by_hand():
        seen = {}
        for _, tokens in docs:
            for term in {" ".join(tokens[i : i + n]) for n in (1, 2, 3) for i in range(len(tokens) - n + 1)}:
                seen[term] = seen.get(term, 0) + 1
        return {t: n for t, n in seen.items() if 60 * 0.05 <= n <= 60 * 0.5}

    assert dict(values(textprep.ngram_vocabulary(df, "t", 3, 0.05, 0.5), "term", "docs")) == by_hand()
    monkeypatch.setattr(textprep, "FREQUENT_WORDS", 1)
    assert dict(values(textprep.ngram_vocabulary(df, "t", 3, 0.05, 0.5), "term", "docs")) == by_hand()


def test_phrase_scores(spark):
    docs = [(i, ["new", "york", "is", "big"]) for i in range(8)] + [(9, ["is", "big"]), (10, [])]
    df = spark.createDataFrame(docs, "k int, t array<string>")
    got = {(r.a, r.b): r.score for r in textprep.learn_phrases(df, "t", min_count=5, threshold=0.0).collect()}
    size = 4 + 3
    assert got[("new", "york")] == pytest.approx(3 * size / 64)
    assert got[("is", "big")] == pytest.approx(4 * size / 81)
    assert len(got) == 3


def test_word_lists_are_quoted(spark):
    words = ["it's", 'say "x"', "back\\slash", "plain", "\\'"]
    df = spark.createDataFrame([(words + ["other"],), ([],)], "t array<string>")
    got = [r[0] for r in df.select(x.known_or_null("t", words)).collect()]
    assert got == [words + [None], []]
    assert [len(r[0]) for r in df.select(x.positions_of("t", words)).collect()] == [5, 0]


@pytest.mark.parametrize("vectors", [[[0.0, 1.0], [1.0, 0.0]], [[0.0, 1.0]], [[0.0, 1.0]] * 5, [[0.0, 1.0], [1.0, 0.0]] * 4])
def test_fewer_vectors_than_topics(spark, vectors):
    df = spark.createDataFrame(list(enumerate(vectors)), "k int, v array<double>")
    assigned = topics.assign_topics(df, "v", topics.fit_topics(df, "v", 4)).collect()
    assert len(assigned) == len(vectors)
    assert all(r.Topic >= -1 and sum(r.TopicProbability) == pytest.approx(1.0) for r in assigned)


def test_single_topic_has_no_map(spark):
    df = spark.createDataFrame([(0, [0.5, 0.1])], "topic int, vector array<double>").withColumn("n", F.lit(1))
    assert tuple(topics.topic_map(df).first()) == (0, 1, None, None)


# --- results do not depend on sizes ---------------------------------------------------------------------


def test_long_quoted_strings_are_decoded(spark):
    plain, escaped, quotes = "a" * 1_000_000, "\\\\" * 400_000, "it's " * 200_000
    rows = [(f"{{'Id': '{plain}', 'C': None}}",), (f"{{'Id': '{escaped}', 'C': True}}",), (f'{{"Id": "{quotes}", "C": False}}',)]
    df = spark.createDataFrame(rows, "t string")
    found = df.select(files.decode_records("t", "Id string, C string").alias("r")).select("r.*").collect()
    assert [len(r["Id"]) for r in found] == [1_000_000, 400_000, 1_000_000]
    assert [r["C"] for r in found] == [None, "true", "false"]


def test_unicode_spaces_separate_words(spark):
    df = spark.createDataFrame([("Foo\xa0bar\u2009baz,\u30003qux\x1cend",)], "t string")
    assert df.select(x.tokens(x.letters_only("t"))).first()[0] == ["foo", "bar", "baz", "qux", "end"]


def test_references_are_decoded_once(spark):
    cases = {
        "&#38;amp;": "&amp;", "&euro;&pound;": "€£", "&#1114109;&#x10FFFD;": "\U0010fffd\U0010fffd", "&#0;&#xD800;&#9999999;": "\ufffd" * 3,
        "a & b &nope; &amp": "a & b &nope; &amp", "&lt;<![CDATA[x]]>": "<x", "&#00000000065;&CounterClockwiseContourIntegral;": "A∳", "": "",
    }
    df = spark.createDataFrame([(k,) for k in cases], "t string")
    assert [r[0] for r in df.select(pages.unescape("t")).collect()] == list(cases.values())
    assert spark.sql("SELECT CAST(NULL AS STRING) AS t").select(pages.unescape("t")).first()[0] is None


def test_records_of_several_files_keep_their_order(spark, tmp_path):
    for name, n in (("a", 1), ("b", 50), ("c", 400)):
        lines = "\n".join(f'{{"DrugId": "{name}{i}", "GenName": "{"x" * 200}"}}' for i in range(n))
        (tmp_path / f"{name}.json").write_text(lines + "\n")
    records = stages.read_records(spark, str(tmp_path))
    found = [r["DrugId"] for r in records.orderBy("seq").select("DrugId").collect()]
    assert found == [f"{name}{i}" for name, n in (("a", 1), ("b", 50), ("c", 400)) for i in range(n)]


def test_rows_without_vector_have_no_topic(spark):
    rows = [(i, [float(i % 2), float(i % 3), 1.0]) for i in range(30)] + [(30, None), (31, None)]
    df = spark.createDataFrame(rows, "k int, v array<double>")
    found = topics.assign_topics(df, "v", topics.fit_topics(df, "v", 2)).toPandas().set_index("k")
    assert found.loc[[30, 31], ["Topic", "TopicProbability", "UMAP_x", "UMAP_y"]].isna().all().all()
    assert found.loc[:29, "Topic"].notna().all()


def test_failing_texts_are_found_by_halving():
    import pandas as pd

    calls = []

    def predict(batch):
        calls.append(len(batch))
        if "bad" in batch:
            raise ValueError
        return np.ones((len(batch), 3))

    texts = pd.Series(["good"] * 500 + ["bad"] + ["good"] * 523 + [None])
    found = sentiment._scores_or_null(predict, texts)
    assert found["neg"].isna().sum() == 2 and found["neg"].isna()[500]
    assert len(calls) < 40


def test_segments_are_few_files(spark, tmp_path):
    df = spark.range(3000).repartition(16).selectExpr("id", "CASE WHEN id % 3 = 0 THEN 'a' WHEN id % 3 = 1 THEN 'b' END AS DrugFamily", "'x' AS bert_compound_threshold")
    files.write_segments(df, str(tmp_path / "s"), rows_per_file=400)
    count = {p.name: len(list(p.rglob("part-*.parquet"))) for p in (tmp_path / "s").iterdir() if p.is_dir()}
    assert all(n <= 4 for n in count.values()) and len(count) == 3
    assert spark.read.parquet(str(tmp_path / "s")).count() == 3000


def test_large_segment_is_written_by_many_tasks(spark, tmp_path, monkeypatch):
    df = spark.range(4000).selectExpr("id", "'a' AS DrugFamily", "CASE WHEN id = 0 THEN NULL ELSE 'x' END AS bert_compound_threshold")
    files.write_segments(df, str(tmp_path / "s"), rows_per_file=100)
    tasks = {p.name.split("-")[1] for p in (tmp_path / "s").rglob("part-*.parquet")}
    assert len(tasks) >= 25
    assert spark.read.parquet(str(tmp_path / "s")).count() == 4000


def test_long_lexicons_score_the_same(spark, monkeypatch):
    texts = ["a very GOOD day!", "not good but awful", "", None, "a very GOOD day!", "good good bad"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k int, c string")
    lexicon = dims.word_weights(spark, dims.LEXICON)
    scores = lambda: sentiment.add_lexicon_scores(df, "c", lexicon).orderBy("k").collect()
    short = scores()
    monkeypatch.setattr(sentiment, "LEXICON_WORDS", 1)
    assert scores() == short


def test_classifier_takes_texts_apart_once(spark):
    read = spark.sparkContext.accumulator(0)

    def seen(text):
        read.add(1)
        return text

    texts = spark.createDataFrame([(f"good day {i}" if i % 3 else f"bad night {i}", i % 3) for i in range(30)], "t string, y int")
    watched = texts.withColumn("t", F.udf(seen, "string").asNondeterministic()("t"))
    model = sentiment.fit_text_classifier(watched, "t", "y", 64)
    assert read.value == 30
    scored = sentiment.add_classifier_scores(texts, "t", model)
    assert scored.where(F.abs(F.col("bert_neg") + F.col("bert_neu") + F.col("bert_pos") - 1) > 1e-9).count() == 0


def test_spaces_and_letters_of_all_characters(spark):
    known = [chr(i) for i in range(sys.maxunicode + 1) if not 0xD800 <= i < 0xE000]
    rows = [("".join(f"a{c}B{c}{c}" for c in known[i : i + 512]),) for i in range(0, len(known), 512)]
    df = spark.createDataFrame(rows, "t string")
    spaces = f"[{x.SPACE_CLASS}]+"
    plain = lambda t: F.filter(F.split(t, spaces), lambda w: w != "")
    kept = F.regexp_replace(F.lower("t"), rf"[^\p{{L}}\p{{N}}_{x.SPACE_CLASS}]", "")
    letters = F.regexp_replace(kept, r"\p{Nd}+", "")
    same = (plain("t") == x.tokens("t")) & (letters == x.letters_only("t")) & (plain(letters) == x.tokens(x.letters_only("t")))
    assert df.where(same).count() == len(rows)


def test_punctuation_around_lexicon_words(spark):
    lexicon = spark.createDataFrame([("good", 1.9), (":)", 2.0), ("ok", 1.0)], "token string, weight double")
    texts = {"(good)": 1.9, "...good": 1.9, "good-": 1.9, "go.od": 0, ":)": 2.0, "ok.": 0, "--": 0, "a \"GOOD.\" day": 1.9 + 0.733, "\"GOOD.\"": 1.9}
    df = spark.createDataFrame([(k, float(v)) for k, v in texts.items()], "c string, s double")
    for r in sentiment.add_lexicon_scores(df, "c", lexicon).collect():
        assert r.vader_compound == round(r.s / math.sqrt(r.s * r.s + 15), 4), r.c
