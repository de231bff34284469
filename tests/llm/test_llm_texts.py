"""Extraction, quality, tokens and packing against plain Python."""

import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from reviewlens.llm import html_extract, kernels, packing, quality, tokens, wordpiece

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MENU = '<nav><ul><li><a href="/a">Home</a></li><li><a href="/b">News</a></li></ul></nav>'
LINES = [f"Paragraph {i}, with some commas, and enough words to be counted as a paragraph of an article." for i in range(4)]
BODY = "".join(f"<p>{x}</p>" for x in LINES)

PAGES = [
    (f"<html><head><title>T</title><style>p{{}}</style></head><body>{MENU}<article><h1>Title</h1>{BODY}</article><footer>foot, er</footer></body></html>", "Title " + " ".join(LINES)),
    (f"<body>{MENU}<div class='content'>{BODY}</div><div id='sidebar'><p>{LINES[0]}</p></div><div class='comments'>{BODY}</div></body>", " ".join(LINES)),
    (f"<body><header>Site</header><main><section>{BODY}</section></main><form><p>{LINES[1]}</p></form></body>", " ".join(LINES)),
    ("<article><p>1 &lt; 2 &amp;amp; 3&nbsp;&#x41;&euro;</p><!-- no --><script>var a='</p>';</script></article>", "1 < 2 &amp; 3 A€"),
    ("<article><p>open <b>bold<br><p>next  \n one<li>item</article>", "open bold next one item"),
    ("<div class=ad>buy</div>plain text", "plain text"), ("", ""), (None, ""), ("<", "<"), ("a < b", "a < b"), ("<p", ""),
    ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"), ("<article><p>" + "long text, " * 50_000 + "</p></article>", ("long text, " * 50_000).strip()),
]


@pytest.mark.parametrize("page, text", PAGES)
def test_main_text(page, text):
    assert html_extract.main_text(page) == text


TEXT = " ".join(LINES)
# Names that do not part an article from its page, and some that do.
NAMED = [
    (f'<body>{MENU}<div class="elementor-widget elementor-widget-text-editor">{BODY}</div><footer>foot, er</footer></body>', TEXT),
    ("<body><div class='page'>" + "".join(f"<div class='elementor-widget'><p>{x}</p></div>" for x in LINES) + "</div></body>", TEXT),
    (f'<body><div class="content has-sidebar">{BODY}</div><div class="sidebar"><p>{LINES[0]}</p></div></body>', TEXT),
    (f"<body><div class='content comments-open'>{BODY}</div><div class='comments'>{3 * BODY}</div></body>", TEXT),
    (f"<body><div class='content'>{BODY}</div><div id='cookieNotice'>{3 * BODY}</div></body>", TEXT),
    (f"<body><div class='comment'>{BODY}</div></body>", TEXT),
    (f"<body><form action='x'>{MENU}<div id='content'>{BODY}</div><select><option>one</select></form></body>", TEXT),
    (f"<article>{BODY}<pre><span class='token comment'># note</span> code <i id='ad'>b</i></pre></article>", f"{TEXT} # note code b"),
    (f"<article>{BODY}<p><math><mi>x</mi><mo>=</mo><mn>1</mn><annotation>x=1</annotation></math></p></article>", f"{TEXT} x=1"),
    (f"<article>{BODY}<p>Read <a title='the hidden cost' data-id='ad'>more</a> on</p></article>", f"{TEXT} Read more on"),
    (f"<article>{BODY}<p alt=\"x display:none y\">Shown</p><p hidden>a</p><p HIDDEN=''>b</p><i aria-hidden=true>c</i></article>", f"{TEXT} Shown"),
    (f"<article>{BODY}<div class='Sidebar'>a</div><div class='sideBar'>b</div><div id='relatedLinks'>c</div><div class='ADBanner'>d</div></article>", TEXT),
    (f"<article>{BODY}<div class='Loads'>a</div><div class='Bad'>b</div><p class='Cadé'>c</p></article>", f"{TEXT} a b c"),
    (f"<article>{BODY}one<div class='ad'>x</div>two</article>", f"{TEXT} one two"),
]


SHORT = "A short report on one event of the day, which says in two sentences, and no more, what has been known of it. The rest is to be told later."
TEASERS = "".join(f"<p>Teaser number {i} of another story, with a few words more, and an end that makes one curious.</p>" for i in range(12))
# Parts that are longer than the article, and what readers wrote.
LONG_PARTS = [
    (f'<body>{MENU}<div class="content"><h1>Title</h1><p>{SHORT}</p></div><div class="sidebar">{TEASERS}</div></body>', f"Title {SHORT}"),
    (f'<body><div id="page"><h1>Title</h1><p>{SHORT}</p></div><aside id="right-sidebar">{TEASERS}</aside></body>', f"Title {SHORT}"),
    (f"<body><div class='story'><p>{SHORT}</p></div><footer>{TEASERS}</footer></body>", SHORT),
    (f"<body><article><h1>Title</h1>{BODY}<section><article class='comment'><p>{SHORT}</p></article></section></article></body>", f"Title {TEXT}"),
    (f"<body><article><h1>Title</h1>{BODY}</article><article class='comment depth-1'><p>{SHORT}</p></article></body>", f"Title {TEXT}"),
    (f"<body><div><p>{SHORT[:57]}</p></div><div class='comments'>{BODY}</div></body>", SHORT[:57]),
    (f"<body><div class='article-comments'>{BODY}</div><div class='article-body'><p>{SHORT}</p></div></body>", SHORT),
    (f"<body><div class='main sidebar-right'>{BODY}</div><div class='main-sidebar'>{TEASERS}</div></body>", TEXT),
    (f"<body><div class='advert'>{TEASERS}</div><div class='cookie-notice'>{BODY}</div><p>{SHORT}</p></body>", SHORT),
    (f"<body><div class='sidebar'><h1>Title</h1>{BODY}</div><footer>{TEASERS}</footer></body>", f"Title {TEXT}"),
    (f"<body><form id='page'><div class='content'>{BODY}</div><div class='newsletter'><p>{SHORT}</p></div></form></body>", TEXT),
    (f"<body><div class='content'><p>{SHORT}</p><form><p>Write to us, if you like, or leave it, as you please.</p></form></div></body>", SHORT),
    (f"<body><article class='post sponsored'><h1>Title</h1>{BODY}</article></body>", f"Title {TEXT}"),
]


@pytest.mark.parametrize("page, text", LONG_PARTS)
def test_long_parts_are_no_article(page, text):
    assert html_extract.main_text(page) == text


HOSTILE = [
    lambda n: "<b>" * n + "</div>" * n, lambda n: "<b>" * n + "<p>x</p>" * n, lambda n: "<div>" * n + "<li>x</li>" * n,
    lambda n: "<b><div>" + "<i>" * n + "</b>" * n, lambda n: "<div>" * n + "<header>x</header>" * n, lambda n: "<div class='widget'>" * n + "x" * 100,
    lambda n: "<article>" * n + "text, and more text than a few words" + "</article>" * n,
]


@pytest.mark.parametrize("page", HOSTILE)
def test_time_grows_with_the_page(page):
    import time

    def seconds(n):
        start = time.process_time()
        html_extract.main_text(page(n))
        return time.process_time() - start

    seconds(1_000)
    assert seconds(100_000) < 3 + 30 * seconds(10_000)


@pytest.mark.parametrize("page, text", NAMED)
def test_main_text_of_named_blocks(page, text):
    assert html_extract.main_text(page) == text


def test_pages_query(spark, data):
    pages = spark.createDataFrame([(1, "u", PAGES[0][0], "x"), (1, "u", PAGES[0][0], "x"), (None, None, None, "y")], "page_id long, url string, html string, text string")
    found = html_extract.extract(pages).collect()
    assert Counter(map(tuple, found)) == Counter({(1, "u", PAGES[0][1], len(PAGES[0][1])): 2, (None, None, "", 0): 1})
    assert html_extract.extract(pages.limit(0)).count() == 0
    for r in spark.read.parquet(f"{data}/pages.parquet").limit(50).collect():
        inside = re.search(r"<article>(.*?)</article>", r["html"], re.S)[1]
        import html

        expected = " ".join(html.unescape(re.sub(r"</?(p|h1|br)>", " ", inside).replace("<b>", "")).split())
        assert html_extract.main_text(r["html"]) == expected


def base_expected(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(tuple(words[i : i + 3]) for i in range(len(words) - 2))
    covered = {i + j for i in range(len(words) - 2) if grams[tuple(words[i : i + 3])] > 1 for j in range(3)}
    seen, again = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 50 or 100 * len(covered) > 50 * len(words)
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), again, len(covered), failed


def test_quality_rows(edge, rows, labels):
    found = quality.judge(edge, labels).collect()
    got = Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in found)
    assert got == Counter((r[0], *base_expected(r[1])) for r in rows)
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD) for r in found)


def test_quality_score(edge, rows, labels):
    """The ratio by dictionaries, one text at a time."""
    raw, target = Counter(), Counter()
    good = {0, 2, 6, 13}
    per = []
    for r in rows:
        buckets = Counter(quality.features(kernels.Texts(pa.array([r[1] or ""])))[0].tolist())
        words = WORD.findall(r[1] or "")
        assert sum(buckets.values()) == len(words) + max(len(words) - 1, 0)
        raw.update(buckets)
        if r[0] in good:
            target.update(buckets)
        per.append((r[0], buckets))
    n_raw, n_target, c = sum(raw.values()), sum(target.values()), quality.PSEUDO_COUNT
    expected = Counter()
    for doc_id, buckets in per:
        n = sum(buckets.values())
        ratio = lambda b: np.log((target[b] + c) / (n_target * raw[b] / n_raw + c))
        expected[(doc_id, round(sum(v * ratio(b) for b, v in buckets.items()) / n if n else 0.0, 9))] += 1
    assert Counter((r["doc_id"], round(r["score"], 9)) for r in quality.judge(edge, labels).collect()) == expected


def test_quality_keeps_good_documents(spark, data, documents):
    labels = spark.read.parquet(f"{data}/labels.parquet")
    judged = quality.judge(documents, labels).join(labels, "doc_id").where("not base_failed")
    good = judged.where("quality = 1")
    assert good.where("kept").count() == good.count()
    kept = quality.good_documents(documents, labels)
    assert kept.columns == documents.columns
    assert kept.count() == quality.judge(documents, labels).where("kept").count()


def test_quality_without_trust_and_rows(edge, empty, labels):
    assert {r["score"] for r in quality.judge(edge, labels.limit(0)).collect()} == {0.0}
    assert quality.judge(empty, labels).count() == 0


TOKENIZER = Tokenizer.from_file(public_tokenizers.path(tokens.VOCABULARY))


def encoded(text):
    ids, _ = tokens.encoder().encode(pa.array([text], pa.string()))
    return ids[:-1].tolist()


@settings(max_examples=300, deadline=None)
@given(st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t\x1c\x85\xa0'st1²½ßİ.,!<|>ÉéǅΣ́‍你🙂")), st.characters(codec="utf-8")), max_size=60))
def test_token_ids(text):
    assert encoded(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("text", ["a<|endoftext|>b", "<|startoftext|>", "I'll don't WE'RE 12", "\x1ca\x1db", "x" * 5000, "aȺb Ⱦ İx", "a\x0bb\x0c\x85!\xa0!", "\x00 \x7f \xad"])
def test_token_ids_of_special_texts(text):
    assert encoded(text) == TOKENIZER.encode(text, add_special_tokens=False).ids


HARD_TEXT = st.text(alphabet=st.one_of(st.sampled_from(list(" \n\t\x1c\x85\xa0'st1²½ßİ.,!<|>ÉéǅΣ你")), st.characters(codec="utf-8")), max_size=30)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.one_of(HARD_TEXT, st.sampled_from(["", " ", "I'll do", "a<|endoftext|>b", "\x1ca", "x" * 300, " two  words "])), max_size=6))
def test_token_ids_of_several_texts(texts):
    ids, begins = tokens.encoder().encode(pa.array(texts, pa.string()))
    expected = [TOKENIZER.encode(t, add_special_tokens=False).ids + [0] for t in texts]
    assert ids.tolist() == [i for own in expected for i in own]
    assert np.diff(begins).tolist() == [len(own) for own in expected]


def test_full_tables_keep_frequent_words():
    made = []
    table = tokens._Table(lambda word: made.append(word) or b"x", 8)
    for i in range(100):
        table["often"], table[f"w{i}"]
    assert made.count("often") == 1 and len(table) + len(table.older) <= 8


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 6), min_size=21, max_size=21), st.integers(1, 40))
def test_plan_holds_every_piece(counts, scale):
    histogram = np.array(counts) * scale
    histogram[0] = 0
    made = np.zeros(21, int)
    for lengths, n in packing.plan_sequences(histogram):
        assert sum(lengths) <= 20 and n > 0
        for length in lengths:
            made[length] += n
    assert (made == histogram).all()


def test_patterns_fill_the_capacity():
    triples = packing.patterns(30)
    assert (triples.sum(axis=1) == 30).all()
    assert {tuple(t) for t in triples.tolist()} == {(a, b, 30 - a - b) for a in range(11) for b in range(a, 31) if b <= 30 - a - b}


def test_fit_finds_exact_patterns():
    histogram = np.zeros(31)
    histogram[[10, 20, 7, 23, 30]] = [50, 50, 30, 30, 9]
    assert sum(n for _, n in packing.plan_sequences(histogram.astype(int))) == 89


@pytest.mark.parametrize("capacity", [2048, 64])
def test_pack(edge, rows, capacity):
    found = packing.pack(edge, capacity).collect()
    expected = Counter()
    for r in rows:
        ids = TOKENIZER.encode(r[1] or "", add_special_tokens=False).ids + [packing.CLOSING_ID]
        for k, at in enumerate(range(0, len(ids), capacity)):
            part = ids[at : at + capacity]
            expected[(r[0], k, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes()))] += 1
    assert Counter(tuple(r)[:5] for r in found) == expected
    sequences = defaultdict(list)
    for r in found:
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    for places in sequences.values():
        end = 0
        for offset, length in sorted(places):
            assert offset == end
            end += length
        assert end <= capacity
    least = -(-sum(r["length"] for r in found) // capacity)
    assert len(sequences) <= 1.05 * least + 1


def test_pack_empty_table(empty):
    assert packing.pack(empty).count() == 0


def greedy(word, vocabulary, longest):
    n = at = 0
    while at < len(word):
        at += next(k for k in range(min(longest, len(word) - at), 0, -1) if word[at : at + k] in vocabulary)
        n += 1
    return n


VOCABULARY = wordpiece.read_vocabulary()
KNOWN, LONGEST = set(VOCABULARY), max(map(len, VOCABULARY))


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.binary(max_size=60), st.lists(st.sampled_from(VOCABULARY[::97]), max_size=8).map(b"".join)))
def test_automaton_counts_greedy_pieces(word):
    assert wordpiece.counts().automaton.count(word) == greedy(word, KNOWN, LONGEST)


def test_token_counts(edge, rows, empty):
    found = Counter(map(tuple, wordpiece.token_counts(edge).collect()))
    expected = Counter()
    for r in rows:
        words = (r[1] or "").encode().split()
        expected[(r[0], len(words), sum(greedy(b" " + w, KNOWN, LONGEST) for w in words))] += 1
    assert found == expected
    assert wordpiece.token_counts(empty).count() == 0


def test_vocabulary_must_hold_all_bytes():
    with pytest.raises(ValueError):
        wordpiece.Automaton([b"a", b"ab"])
