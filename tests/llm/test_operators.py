"""Every operator and stage on planted and awkward rows, against brute force."""

import itertools
import os
import random
import re
import sys
from collections import Counter

import numpy as np
import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

from pyspark.sql import functions as F  # noqa: E402

import corpus_pipeline  # noqa: E402
from longctx.llm import decontam, langid, mainhtml, nbsvm, neardup, quality, spm, substrings, urls, warc  # noqa: E402
from longctx.llm.components import connected_components  # noqa: E402
from longctx.llm.queries import MODEL_PATH, URL_RULES  # noqa: E402
from longctx.llm.words import text_shingles  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, key string, component_id int, label int"


@pytest.fixture(scope="module")
def spark():
    from longctx.session import local_session, ship_package
    s = local_session(4, 4, app="longctx-llm-tests")
    ship_package(s)
    yield s


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(n))


def planted():
    """Clean, copied, edited, truncated, repeated, empty, null and long texts; clashing column names."""
    rng = random.Random(11)
    base, other, passage = prose(rng, 200), prose(rng, 300), prose(rng, 60)
    texts = [base, base, base.upper()]
    for k in range(12):  # edited copies, some of them below the threshold against the first
        w = base.split()
        for _ in range(1 + 2 * k):
            w[rng.randrange(len(w))] = prose(rng, 1)
        texts.append(" ".join(w))
    w = other.split()
    texts += [other, " ".join(w[:270]), " ".join(w[:235]), " ".join(w[:200])]
    texts += [prose(rng, 80) + "\n" + passage + "\n" + prose(rng, 70) for _ in range(5)]
    texts += [None, "", " \t\n", "one two", "one  TWO", "solo", "x " * 3000, prose(rng, 9000), "日本語 テキスト です", "12 34 !!"]
    texts += [prose(rng, rng.randint(30, 120)) for _ in range(10)]
    rows = [(i, t, rng.choice(["en", "fr", None]), rng.choice(["a", None]), len(t or ""), "r", "k", 7, 1) for i, t in enumerate(texts)]
    return rows + [rows[0], (None, base, "en", "a", 1, None, None, None, None), (None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(planted(), SCHEMA).repartition(3)


def shingles(t):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    return frozenset(tuple(w[p:p + 5]) for p in range(max(1, len(w) - 4))) if w else frozenset()


def components(sets, links):
    top = {i: i for i in sets}

    def find(x):
        while top[x] != x:
            x = top[x]
        return x
    for a, b in links:
        x, y = find(a), find(b)
        top[max(x, y)] = min(x, y)
    return {i: find(i) for i in sets}


def test_near_duplicates_equal_brute_force(docs):
    sets = {r[0]: shingles(r[1]) for r in planted() if r[0] is not None}
    links = [(a, b) for a, b in itertools.combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    assert len(set(want.values())) < len(want) - 7
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(planted())
    for r in got:
        if r.doc_id is None:
            assert r.component_id is None and r.kept
        else:
            assert (r.n_shingles, r.component_id, r.kept) == (len(sets[r.doc_id]), want[r.doc_id], want[r.doc_id] == r.doc_id)


def test_many_near_copies_of_an_absent_origin(spark):
    """No member is close to all others: chains and pairs that only share an edit must still be found."""
    rng = random.Random(4)
    base, rows = prose(rng, 150).split(), []
    for i in range(60):
        w = list(base if i % 3 else rows[-1][1].split() if rows else base)
        for _ in range(rng.randint(2, 7)):
            w[rng.randrange(len(w))] = prose(rng, 1)
        rows.append((i, " ".join(w)))
    sets = {i: shingles(t) for i, t in rows}
    links = [(a, b) for a, b in itertools.combinations(sets, 2) if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b])]
    want = components(sets, links)
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == want


def unlike_hubs():
    """Two near copies, and in each bucket they share 30 heavier documents that are like each other but unlike them."""
    rng = random.Random(6)
    x = prose(rng, 150).split()
    y = [*x[:60], *prose(rng, 9).split(), *x[69:]]
    hashes = [text_shingles(np.frombuffer(" ".join(t).encode(), np.uint8)) for t in (x, y)]
    a, b = (neardup.signature(h) for h in hashes)
    least = (neardup._A * hashes[0][None, :] + neardup._B).argmin(axis=1)
    rows = [(1000, " ".join(x)), (1001, " ".join(y))]
    for k in range(neardup.BANDS):
        band = slice(neardup.ROWS * k, neardup.ROWS * (k + 1))
        if (a[band] == b[band]).all():
            for _ in range(200):  # the words added must not take the band's minima over
                text = prose(rng, 8) + " " + " ".join(" ".join(x[p:p + 5]) + " " + prose(rng, 1) for p in least[band])
                t = neardup.signature(text_shingles(np.frombuffer(text.encode(), np.uint8)))
                if (t[band] == a[band]).all():
                    break
            rows += [(k * 30 + j, f"{text} {prose(rng, 1)}") for j in range(30)]
    return rows


def test_near_copies_whose_hubs_are_unlike_them(spark):
    rows = unlike_hubs()
    x, y = (shingles(t) for _, t in rows[:2])
    assert 100 * len(x & y) >= 75 * len(x | y) and len(rows) > 90
    got = {r.doc_id: r.component_id for r in neardup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1001] == got[1000] == 1000


def test_members_of_an_outgrown_main_component_still_meet(spark):
    """X and Z join and outgrow M, the first main; the only link between x in X and y in M must be tested all the same."""
    x, z, m = range(0, 12), range(100, 112), range(200, 220)
    order = [x[1], z[1], x[0], *z[2:], *x[2:], z[0], *m]
    ranked = spark.createDataFrame([(1, d, k) for k, d in enumerate(order)], "key long, doc long, rank long")
    comp = spark.createDataFrame([(d, g[0]) for g in (x, z, m) for d in g], "node long, component long")
    links = spark.createDataFrame([(g[0], d) for g in (x, z, m) for d in g[1:]], "a long, b long")
    linked = {frozenset((z[1], x[2])), frozenset((x[0], m[19]))}
    assert order.index(m[19]) >= neardup.STEP > order.index(x[0])

    def verify(pairs):
        found = [(r.hub, r.mem, frozenset((r.hub, r.mem)) in linked) for r in pairs.collect()]
        return spark.createDataFrame(found, "a long, b long, link boolean")
    got = {r.node: r.component for r in neardup._ranked_rounds(ranked, links, comp, verify).collect()}
    assert set(got.values()) == {0}


def test_components(spark):
    edges = [(1, 2), (2, 3), (9, 8), (8, 8), (3, 1), (None, 4), (20, 10), (10, 5), (5, 30)]
    got = {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8, 5: 5, 10: 5, 20: 5, 30: 5}


def test_repeated_passages(docs):
    want = set()
    runs = {}
    for i, t, *_ in planted():
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        for p in range(len(w) - 49):
            runs.setdefault(tuple(w[p:p + 50]), set()).add(i)
    for ids in runs.values():
        ids.discard(None)
        if len(ids) > 1:
            want |= ids
    got = substrings.repeated_passages(docs).collect()
    assert want <= {r.doc_id for r in got}
    assert all(r.end_word - r.start_word >= 50 and r.class_id <= r.doc_id for r in got)
    clean = {i for i, *_ in planted() if i is not None and i >= len(planted()) - 13}
    assert not clean & {r.doc_id for r in got}


def test_near_copies_miss_rate_with_context():
    """Tokens of 50 words of which some are changed: chance that no hash function gives a shared key."""
    n, size, worst = substrings.MIN_TOKENS, substrings.MIN_WORDS, {}
    edits = [e for k in (1, 2) for e in itertools.combinations(range(size), k)]
    edits += [(*range(x), *range(size - y, size)) for x in range(7) for y in range(7 - x)]  # more of them only fit at the ends
    for changed in edits:
        gone = {t for p in changed for t in range(p - 4, p + 1) if 0 <= t < n}
        if n - len(gone) >= substrings.MIN_MATCH:
            left = set(range(n)) - gone
            found = sum(c - substrings.CONTEXT in left or c + substrings.CONTEXT in left for c in left) / (n + len(gone))
            worst[len(changed)] = max(worst.get(len(changed), 0), (1 - found) ** substrings.HASHES)
    assert worst[1] <= 0.008 and max(worst.values()) <= 0.015


def test_passages_with_one_changed_word(spark):
    rng, rows = random.Random(21), []
    for k in range(60):
        passage = prose(rng, 50).split()
        edited = [*passage[:20 + k % 10], "changed", *passage[21 + k % 10:]]
        rows += [(2 * k + j, f"{prose(rng, 30)} {' '.join(p)} {prose(rng, 30)}") for j, p in enumerate((passage, edited))]
    got = {r.doc_id for r in substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == set(range(120))


@pytest.mark.parametrize("pairs, block", [(1, 256), (9, 4)])
def test_members_that_the_first_and_last_document_do_not_cover(spark, monkeypatch, pairs, block):
    """A template of 28 words in all, with another ending in the first and the last document than in each two between them."""
    monkeypatch.setattr(substrings, "BLOCK", block)
    rng, rows, want, n = random.Random(8), [], {}, 2 * pairs + 2
    for k in range(60 if pairs == 1 else 8):
        template, ids = prose(rng, 28), list(range(k * n, k * n + n))
        ends = [prose(rng, 27) for _ in range(pairs)]
        for place, doc in enumerate(ids):
            end = prose(rng, 27) if place in (0, n - 1) else ends[(place - 1) % pairs]
            rows.append((doc, f"{prose(rng, 30)} {template} {end} {prose(rng, 30)}"))
        for place in range(1, pairs + 1):
            want |= {ids[place]: (ids[place], False), ids[place + pairs]: (ids[place], True)}
    got = substrings.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: (r.class_id, r.repeat) for r in got} == want and len(got) == len(want)
    assert all(r.start_word <= 30 and r.end_word >= 85 for r in got)


def test_remove_repeats_keeps_first_and_rest(docs):
    left = substrings.remove_repeats(docs)
    assert left.columns == docs.columns
    seen = {}
    for r in left.collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", (r.text or "").lower())
        for p in range(len(w) - 49):
            seen.setdefault(tuple(w[p:p + 50]), set()).add(r.doc_id)
    assert not [s for s in seen.values() if len(s - {None}) > 1]
    assert {r.doc_id for r in left.collect()} >= {19, 20, 21, 22, 23}  # they lose the passage, not the rest


def test_contaminated_equals_brute_force(spark, docs):
    rng = random.Random(8)
    items = [(k, prose(rng, n)) for k, n in enumerate((15, 22, 40, 59))] + [(7, "few words here"), (8, None), (9, ""), (None, "x y")]
    leak = items[2][1]
    edited = leak.split()
    edited[-1] = "changed"
    more = [(1000, prose(rng, 30) + " " + leak + " " + prose(rng, 40)), (1001, " ".join(edited)), (1002, leak.upper().replace(" ", ", ")),
            (1003, " ".join(leak.split()[:20]) + " " + prose(rng, 30)), (1004, "so few words here are"), (1005, items[0][1][:40])]
    table = docs.select("doc_id", "text").union(spark.createDataFrame(more, "doc_id long, text string"))
    bench = spark.createDataFrame(items, "item_id long, text string")
    words = lambda t: [x for x in re.split(r"[\W_]+", (t or "").lower()) if x]
    bag = lambda w: Counter(tuple(w[p:p + 5]) for p in range(max(1, len(w) - 4))) if w else Counter()
    want = {}
    for d, t in [(r[0], r[1]) for r in planted()] + more:
        for i, x in items:
            w, item = words(t), words(x)
            if d is None or i is None or not item:
                continue
            best = 0
            for p in range(-len(item) + 1, len(w)):
                a, b = bag(w[max(0, p):max(0, p + len(item))]), bag(item)
                best = max(best, (a & b).total() / (a | b).total())
            if best >= 0.75:
                want[d, i] = best
    got = {(r.doc_id, r.item_id): r.similarity for r in decontam.contaminated(table, bench).collect()}
    assert got.keys() == want.keys() == {(1000, 2), (1001, 2), (1002, 2), (1004, 7)}
    assert all(0.75 <= got[k] <= want[k] + 1e-9 for k in want)  # brute force also tries windows cut off at a text's ends
    assert got[1000, 2] == got[1002, 2] == got[1004, 7] == 1.0
    assert decontam.contaminated(table, bench.where("1 = 0")).count() == 0


def test_contaminated_by_a_reordered_item(spark):
    rng = random.Random(12)
    one, two = prose(rng, 20), prose(rng, 20)
    table = [(k, f"{prose(rng, 30 + k)} {two} {one} {prose(rng, 25)}") for k in range(4)] + [(9, f"{two} {prose(rng, 50)} {one}"), (10, f"{two} {one}")]
    got = {(r.doc_id, r.item_id, r.start_word): r.similarity for r in decontam.contaminated(
        spark.createDataFrame(table, "doc_id long, text string"),
        spark.createDataFrame([(1, f"{one} {two}")], "item_id long, text string")).collect()}
    assert got == {(k, 1, 30 + k): 0.8 for k in range(4)} | {(10, 1, 0): 0.8}


def test_quality_counts_and_verdicts(spark, docs):
    rng = random.Random(3)
    rows = [(i, prose(rng, 60) + ".", "en", "s") for i in range(200)]
    rows += [(500 + i, " ".join(f"{w}%%%" for w in prose(rng, 60).split()), "en", "s") for i in range(5)]
    got = {r.row.doc_id: r for r in quality.judge(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"),
                                                  ["doc_id"]).collect()}
    assert all(got[i].kept for i in range(200)) and not any(got[500 + i].kept for i in range(5))
    halves = spark.createDataFrame([(*r[:3], "ab"[r[0] % 2]) for r in rows if r[0] < 500] + [
        (600 + i, " ".join(f"{w}%%%" for w in prose(rng, 90).split()), "en", "a") for i in range(3)], "doc_id long, text string, lang string, source string")
    split = quality.judge(halves, ["doc_id"]).collect()  # one group is estimated by itself, the others as they can
    assert all(r.distance is not None for r in split) and {r.row.doc_id for r in split if not r.kept} == {600, 601, 602}
    for r in quality.judge(docs, ["doc_id", "text"]).collect():
        t = r.row.text or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        assert (r.n_words, r.word_chars) == (len(w), sum(map(len, w)))
        assert r.kept or r.base_failed
        assert r.base_failed == (len(w) < 20 or 100 * r.n_repeat_words > 30 * len(w))


def test_language_and_classifier_on_awkward_rows(spark, docs):
    model = langid.train(docs.select("lang", "text"))
    for r in langid.predict(docs, model, ["text"]).collect():
        letters = any(c.isalpha() for c in r.row.text or "")
        assert (r.lang_pred in ("en", "fr") and 0 < r.score <= 1) if letters else (r.lang_pred, r.score) == ("und", 0.0)
    none = langid.train(docs.where("1 = 0").select("lang", "text"))
    assert {r.lang_pred for r in langid.predict(docs, none, ["doc_id"]).collect()} == {"und"}
    rng = random.Random(1)
    rows = [(i, prose(rng, 40) + (" zz!!" * 5 if i % 4 == 0 else "")) for i in range(200)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 0)) for i in range(150)] + [(0, 0), (None, 1), (5, None)], "doc_id long, label int")
    scores = {r.row.doc_id: r.score for r in nbsvm.score(table, nbsvm.train(table, labels), ["doc_id"]).collect()}
    assert all((scores[i] >= 0.5) == (i % 4 != 0) for i in range(150, 200))
    empty = nbsvm.train(table, labels.where("1 = 0"))
    assert {r.score for r in nbsvm.score(docs, empty, ["doc_id"]).collect()} == {0.5}


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header><h2>Site name</h2></header><nav><ul><li><a href="/a">Home</a><li><a href="/b">News</a></ul></nav>
<div class="cookie-notice">We use cookies to make this site better for all of you, please accept them now.</div>
<div id="content"><h1>A heading</h1><p>First paragraph with <b>bold</b> and a <a href="x">link</a> in a
   long &lt;sentence&gt; of several words that goes on.<br>After the break.<p>Second paragraph, not closed, is also long enough to count.
<p>Short.</p><p>Third paragraph closes the article with some more words in it, as is usual.</p>
<form><label>Mail</label><input name=q><button>Send now</button></form></div>
<aside class="sidebar"><p>A long sidebar text that says many things nobody wants to read in the article itself.</p></aside>
<div class="comments"><p>I am a reader and I have a long opinion on this article that is not part of it.</p></div>
<footer>&copy; 2020 Somebody</footer></body></html>"""


def test_main_text(spark):
    rows = [(1, PAGE), (2, None), (3, ""), (4, "plain words only, with no tags at all but quite a few of them in one line"), (5, "<p>cut <b off")]
    got = {r.row.page_id: r for r in mainhtml.extract(spark.createDataFrame(rows, "page_id long, html string"), ["page_id"]).collect()}
    assert got[1].text == (
        "A heading\n\nFirst paragraph with bold and a link in a long <sentence> of several words that goes on. After the break.\n\n"
        "Second paragraph, not closed, is also long enough to count.\n\nShort.\n\n"
        "Third paragraph closes the article with some more words in it, as is usual.")
    assert got[2].text == got[3].text == "" and got[4].text == rows[3][1]
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_warc_round_trip_and_damage(spark, tmp_path):
    rng = random.Random(2)
    rows = [(i, f"http://h/{i}", f"<p>{prose(rng, 300)}</p>") for i in range(300)]
    rows += [(400 + i, None, "<p>same</p>") for i in range(20)] + [(500, "u\r\nx", None), (501, "u", ""), (None, "u", "z")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    folder = f"file://{tmp_path}/w"
    warc.write_archives(pages, folder)
    got = {r.page_id: r for r in warc.resolve_revisits(warc.read_archives(spark, folder)).collect()}
    assert len(got) == len(rows) - 1 and all(r.valid for r in got.values())
    for i, _, html in rows[:-1]:
        data = (html or "").encode()
        assert (got[i].payload_bytes, got[i].payload_digest) == (len(data), warc.sha1_base32(data))
    assert {got[400 + i].refers_to for i in range(19)} == {419} and got[419].record_type == "response"
    assert (got[500].refers_to, got[501].record_type) == (501, "response")
    path = next(p for p in sorted((tmp_path / "w").glob("archive-*")) if p.stat().st_size > 2000)
    path.write_bytes(path.read_bytes()[:-7])
    assert warc.read_archives(spark, folder).where("not valid").count() == 1


def test_url_rules_and_templates(spark):
    rows = [(1, "http://A.example.ORG/en/2"), (2, "https://x.example.org/es/1?q"), (3, "http://example.org/en/1z"), (4, "http://s.com/fr/x"),
            (5, "http://s.com/de/"), (6, "http://org/"), (7, "no scheme"), (8, None), (9, "http://badexample.org/es/"), (10, "http://s.net#/fr/"),
            (11, "http://y.org"), (11, "http://y.org")]
    got = {r.row.page_id: (r.host, r.path, r.rule, r.verdict) for r in urls.judge_urls(
        spark.createDataFrame(rows, "page_id long, url string"), URL_RULES).collect()}
    assert got == {
        1: ("a.example.org", "/en/2", "org/", "allow"), 2: ("x.example.org", "/es/1", "example.org/es/", "block"),
        3: ("example.org", "/en/1z", "example.org/en/1", "block"), 4: ("s.com", "/fr/x", "com/fr/", "allow"),
        5: ("s.com", "/de/", "com/de/", "block"), 6: ("org", "/", "org/", "allow"), 7: ("", "", None, "allow"), 8: ("", "", None, "allow"),
        9: ("badexample.org", "/es/", "org/", "allow"), 10: ("s.net", "", None, "allow"), 11: ("y.org", "", None, "allow")}
    many = [(i, f"http://h.net/{'bad' if i % 2 else 'good'}/{i}", i % 2) for i in range(60)]
    out = urls.judge_urls(spark.createDataFrame(many, "page_id long, url string, label int"), [], F.col("label")).collect()
    assert all(r.verdict == ("block" if r.row.label else "allow") and r.template in ("/bad/<num>", "/good/<num>") for r in out)


def test_pipeline_stages_on_awkward_and_empty_tables(spark, docs, tmp_path):
    spark.createDataFrame([(1, "some item text of six words")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for table in (docs, docs.where("1 = 0")):
        cur = table
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, cur, str(tmp_path))
            assert out.columns[:len(docs.columns)] == docs.columns
            path = f"{tmp_path}/{name}-{table is docs}"
            out.write.parquet(path)
            cur = spark.read.schema(out.schema).parquet(path)
        vocab = spm.Pieces(open(MODEL_PATH, "rb").read())
        for r in cur.collect():
            assert vocab.decode(r.ids) == r.text and r.n_tokens == len(r.ids)
        assert (cur.count() > 0) == (table is docs)


def test_texts_that_share_an_id_are_judged_each(spark, tmp_path):
    rng = random.Random(9)
    copied, clean, passage, leak = prose(rng, 120), prose(rng, 120), prose(rng, 60), prose(rng, 30)
    rows = [(1, copied), (2, copied), (2, clean), (2, clean), (3, prose(rng, 90)), (3, prose(rng, 90)), (None, copied)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.text) for r in corpus_pipeline.minhash_near_dedup(spark, table, str(tmp_path)).collect())
    assert got == sorted([(1, copied), (2, clean), rows[4], rows[5], (0, copied)])

    spark.createDataFrame([(1, leak)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    rows = [(1, passage + " first"), (2, clean + " " + passage), (2, prose(rng, 200)), (4, clean[:300] + " " + leak), (4, copied)]
    table = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.text for r in corpus_pipeline.substring_dedup(spark, table, str(tmp_path)).collect()}
    assert got >= {rows[0][1], clean, rows[2][1], copied}
    got = {(r.doc_id, r.text) for r in corpus_pipeline.benchmark_decontamination(spark, table, str(tmp_path)).collect()}
    assert got == {*rows[:3], rows[4]}
