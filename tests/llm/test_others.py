"""Licence scan, shards, main text, fingerprints, url filter and quality against plain versions."""

import hashlib
import re
import zlib
from collections import Counter, defaultdict
from urllib.parse import quote

import numpy as np
import pyarrow as pa
import pytest

from mnemoframe.llm import fingerprint, html_extract, license_scan, quality, sharding, url_filter
from mnemoframe.llm.queries import URL_RULES, op3_license_scan, op4_shards, op8_fingerprints, op9_url_filter, op10_quality
from tests.llm.fixtures import BASE, documents, nothing, prose

PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}


def texts_of(spark, folder):
    return {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}


# licence scan


def base_of(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    places, labels = [], set()
    for phrase, label in PHRASES.items():
        parts = phrase.split()
        at = [i for i in range(len(words)) if words[i : i + len(parts)] == parts]
        places += at
        labels |= {label} if at else set()
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


def held_against_base(rows, texts):
    for r in rows:
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == base_of(texts[r["doc_id"]])
        assert set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))
        assert r["labels"] == ",".join(sorted(set(r["labels"].split(",")))) and 0 <= r["score"] <= 1


def test_base_phrases(spark, small):
    rows = op3_license_scan(spark, small).collect()
    texts = texts_of(spark, small)
    assert len(rows) == len(texts)
    held_against_base(rows, texts)


def test_base_phrases_of_awkward_rows(spark):
    docs = documents(spark, clash=("labels", "id"))
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if r["doc_id"] is not None}
    rows = license_scan.scan_licenses(docs)
    assert rows.count() == docs.count()
    held_against_base(rows.where("doc_id IS NOT NULL").collect(), texts)
    assert license_scan.scan_licenses(nothing(spark)).collect() == []


@pytest.mark.parametrize(
    "text,labels",
    [
        ("released under the mit license", {"mit"}),
        ("gnu lesser general public license, version 2.1", {"lgpl-2.1"}),
        ("licensed under the apache license, version 2.0", {"apache-2.0"}),
        ("the permission of the parents", set()),
        ("permission is hereby granted,  free of charge, to any person\nobtaining a copy", {"mit"}),
        ("creative commons attribution-noncommercial-sharealike", {"cc-by-nc-sa"}),
    ],
)
def test_overlaps_leave_one_detection(text, labels):
    found = license_scan.detections(text)
    assert {rule.label for _, _, rule in found} == labels
    assert all(a[1] <= b[0] for a, b in zip(found, found[1:], strict=False))


def test_prefilter_loses_no_match():
    """Every rule's own match holds its keyword and a word of the gate."""
    for text in ["mit license", "apache license 2.0", "see mozilla.org/mpl/2.0", "cc-by-sa 4.0", "bsd-3-clause", "gpl-3.0-or-later", "all rights reserved", "the unlicense"]:
        matching = [r for r in license_scan.rules() if r.pattern.search(text)]
        assert matching and all(r.keyword in text for r in matching)
        assert any(word in text for word in license_scan.GATE)
    assert len(license_scan.rules()) > 300


# shards


def held_shards(rows, texts):
    slots = defaultdict(list)
    for r in rows:
        data = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"]) == (len(data) + 1, zlib.crc32(data))
        assert r["law"] == "key" and 0 <= r["shard"] < 16 and r["grown_shard"] in (r["shard"], 16)
        slots[r["shard"]].append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())


def test_shards(spark, small):
    rows = op4_shards(spark, small).collect()
    texts = texts_of(spark, small)
    assert len(rows) == len(texts)
    held_shards(rows, texts)
    place = {r["doc_id"]: r["shard"] for r in rows}
    moved = sharding.assign_shards(spark.read.parquet(f"{small}/documents.parquet").where("doc_id % 2 = 1").repartition(5))
    assert all(place[r["doc_id"]] == r["shard"] for r in moved.collect())


def test_shards_of_awkward_rows(spark):
    docs = documents(spark, clash=("shard", "slot", "part"))
    texts = {r["doc_id"]: r["text"] for r in docs.where("doc_id IS NOT NULL").collect()}
    rows = sharding.assign_shards(docs).collect()
    assert len(rows) == docs.count()
    nulls = [r for r in rows if r["doc_id"] is None]
    assert len({r["shard"] for r in nulls}) == 1
    held_shards(sharding.assign_shards(docs.where("doc_id IS NOT NULL")).collect(), texts)
    assert sharding.assign_shards(nothing(spark)).collect() == []


def test_draws_follow_weights_and_confine_moves(spark):
    def tree(light):
        return sharding.branch("", sharding.branch("a", sharding.Node("a0", 1.0, shard=0), sharding.Node("a1", light, shard=1)), sharding.branch("b", sharding.Node("b0", 2.0, shard=2), sharding.Node("b1", 2.0, shard=3)))

    ids = spark.range(40_000)
    rows = ids.select(sharding.place(ids["id"], tree(3.0)).alias("x"), sharding.place(ids["id"], tree(1.0)).alias("y")).collect()
    counts = Counter(r["x"] for r in rows)
    for shard, weight in enumerate((1, 3, 2, 2)):
        assert abs(counts[shard] / len(rows) - weight / 8) < 0.01
    # Rows move out of the subtree that lost weight, or within it; never between the other subtree's shards.
    assert all(r["x"] == r["y"] or r["x"] in (0, 1) for r in rows)


# main text

PAGE = """<!doctype html><html><head><title>T</title><style>p {{}}</style><script>var a = "<p>no</p>";</script></head><body>
<header class="site"><a href="/">Home</a></header><nav><ul><li><a href="/a">About us</a></li><li><a href="/b">Contact</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this page better for you.</div>
<article><h1>Of birds &amp; trees</h1><p>The first paragraph has&nbsp;a <a href="#">link</a> and
  several words that tell a story of birds in tall trees.</p>{middle}<p>Caf&eacute; &#x4e2d; closes the story of the birds with some more words.</p></article>
<aside><p>Read also this other thing about fish that we sell to readers.</p></aside>
<form><p>Subscribe to our letter <input name=q></p></form>
<div id="comments"><p>I liked this story very much, thank you for all of it, said a reader.</p></div>
<footer>Copyright by us, all rights reserved</footer></body></html>"""
ARTICLE = ["Of birds & trees", "The first paragraph has a link and several words that tell a story of birds in tall trees.", "Café 中 closes the story of the birds with some more words."]


def test_article_only():
    assert html_extract.main_text(PAGE.format(middle="")) == "\n".join(ARTICLE)
    advert = '<div class="advert">Buy now, only today, at half the price!</div><!-- <p>hidden</p> -->'
    assert html_extract.main_text(PAGE.format(middle=advert)) == "\n".join(ARTICLE)


def test_unmarked_pages_are_decided_by_words_and_density():
    """Without classes, ids and elements that name parts, the tree alone finds the article."""
    plain = re.sub(r"<(/?)(?:article|nav|header|footer|aside)[^>]*>", r"<\1div>", PAGE.format(middle=f"<p>{prose(3, 50)}</p><p>Yes.</p><p><a href=x>A line that is a link.</a></p>"))
    plain = re.sub(r' (?:class|id)="[^"]*"', "", re.sub(r"<form>.*?</form>", "", plain, flags=re.DOTALL))
    lines = html_extract.main_text(plain).split("\n")
    assert lines[: len(ARTICLE) + 3] == [*ARTICLE[:2], prose(3, 50), "Yes.", "A line that is a link.", ARTICLE[2]]
    assert not {"Home", "About us", "Contact", "We use cookies to make this page better for you.", "Copyright by us, all rights reserved"} & set(lines)


def test_markup_corrects_few_blocks(spark):
    """Over real pages words and density decide nearly all blocks; without marks nearly all pages keep their text."""
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r["html"]]
    corrected, blocks, equal = 0, 0, 0
    for page in pages:
        found = html_extract.blocks_of(page)
        for block, row in zip(found, html_extract.features(found), strict=True):
            taken = html_extract.classify(html_extract.tree(), row)
            corrected += taken != (not block.in_furniture and (block.in_article or taken))
            blocks += 1
        stripped = re.sub(r"<(/?)(?:article|nav|footer)[^>]*>", r"<\1div>", re.sub(r' class="[^"]*"', "", page))
        equal += html_extract.main_text(stripped) == html_extract.main_text(page)
    assert corrected < 0.02 * blocks and equal > 0.95 * len(pages)


@pytest.mark.parametrize("page", ['<head><title>t</title><p>Words of the text that stands here for all to read and to keep, more than twenty of them in one long line.', '<article><p>Words before.</p><svg width="3"/><p>Words after the drawing.</p></article>'])
def test_unclosed_head_and_closed_drawing(page):
    assert len(html_extract.main_text(page).split()) >= 6


def test_long_articles_are_whole():
    middle = "".join(f"<p>{prose(k, 60)}</p>" for k in range(200))
    lines = html_extract.main_text(PAGE.format(middle=middle)).split("\n")
    assert lines == [*ARTICLE[:2], *(prose(k, 60) for k in range(200)), ARTICLE[2]]


def test_pages_of_any_kind(spark):
    pages = [(1, "u", PAGE.format(middle="")), (2, None, None), (3, "u", ""), (4, "u", "<p>unclosed <b>tags <script>x"), (5, "u", "<" * 2000), (None, "u", PAGE.format(middle="")), (1, "u", PAGE.format(middle=""))]
    frame = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "'own' AS text")
    rows = html_extract.extract_text(frame).collect()
    assert len(rows) == len(pages) and all(r["n_chars"] == len(r["text"]) for r in rows)
    assert {r["text"] for r in rows if r["page_id"] in (2, 3)} == {""}
    assert html_extract.extract_text(frame.limit(0)).collect() == []


def test_tree_fits_its_table():
    for page in html_extract.LABELLED:
        rows = html_extract._with_neighbours([block[:2] for block in page])
        assert [html_extract.classify(html_extract.tree(), row) for row in rows] == [block[2] for block in page]


def test_neighbours_decide_blocks_of_real_pages(spark):
    """The tree asks own and neighbouring words and densities, and without a neighbour's values decisions change."""
    asked = Counter()

    def walk(node):
        if isinstance(node, tuple):
            asked[html_extract.FEATURES[node[0]]] += 1
            walk(node[2])
            walk(node[3])

    walk(html_extract.tree())
    assert {"density", "words", "density-1", "words+1"} <= set(asked)
    pages = [r["html"] for r in spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select("html").collect() if r["html"]]
    x = np.vstack([html_extract.features(html_extract.blocks_of(page)) for page in pages])
    decide = lambda rows: np.array([html_extract.classify(html_extract.tree(), row) for row in rows])
    before, rng = decide(x), np.random.default_rng(1)
    for names in (["words", "density"], ["words-1", "density-1"], ["words+1", "density+1"]):
        mixed = x.copy()
        at = [html_extract.FEATURES.index(n) for n in names]
        mixed[:, at] = x[rng.permutation(len(x))][:, at]
        assert (decide(mixed) != before).mean() > 0.02, names


# fingerprints


def test_fingerprint_query(spark, small):
    texts = texts_of(spark, small)
    rows = {r["doc_id"]: r for r in op8_fingerprints(spark, small).collect()}
    assert set(rows) == set(texts)
    order = sorted(texts, reverse=True)
    for doc_id, following in zip(order, [*order[1:], order[0]], strict=True):
        text, after, r = texts[doc_id] or "", texts[following] or "", rows[doc_id]
        third = len(text) // 3
        edited = text[: len(text) - third] + after[:third]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert r["fingerprint"] == fingerprint.fingerprint(text) and r["edited_fingerprint"] == fingerprint.fingerprint(edited)
    # Two thirds of a text stay, so the edited text shares about half of both texts' units; the next document shares few.
    near, other = (np.mean([r[c] for r in rows.values()]) for c in ("near_edited", "near_next"))
    assert other + 0.2 < near < 0.6
    assert np.mean([r["near_edited"] > r["near_next"] for r in rows.values() if r["n_chars"] > 200 and r["near_next"] < 1]) > 0.95


def test_fingerprints_of_awkward_rows(spark):
    rows = fingerprint.compare_with_edits(documents(spark, clash=("id", "key", "range"))).collect()
    assert len(rows) == documents(spark).count() and all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in rows)
    by_id = {r["doc_id"]: r for r in rows if r["doc_id"] is not None}
    assert by_id[1]["fingerprint"] == by_id[2]["fingerprint"] and by_id[6]["fingerprint"] == by_id[7]["fingerprint"]
    assert by_id[2]["near_next"] == 1.0
    assert fingerprint.compare_with_edits(nothing(spark)).collect() == []


def test_paragraphs_commute_and_cancel():
    paragraphs = [prose(k, 20) for k in range(12)]
    whole = fingerprint.fingerprint("\n".join(paragraphs))
    assert whole == fingerprint.fingerprint("\n".join(reversed(paragraphs)))
    built = fingerprint.fingerprint("")
    for p in paragraphs:
        built = fingerprint.combine(built, fingerprint.fingerprint(p))
    assert built == whole
    less = fingerprint.combine(whole, fingerprint.fingerprint(paragraphs[3]), -1)
    assert less == fingerprint.fingerprint("\n".join(paragraphs[:3] + paragraphs[4:])) != whole


def test_neighbours_in_a_batch_change_nothing():
    texts = ["ab cd ef", "ef gh", "", None, "gh gh", "gh\ngh", " gh "]
    together = fingerprint.as_text(fingerprint.vectors(pa.array(texts)))
    assert together == [fingerprint.fingerprint(t or "") for t in texts]


def test_likeness_falls_with_shared_text():
    texts = [BASE, BASE, " ".join(BASE.split()[:90]), " ".join(BASE.split()[:40]), prose(77, 120)]
    v = fingerprint.vectors(pa.array(texts, pa.large_string()))
    one = {k: x[:1].repeat(4, axis=0) for k, x in v.items()}
    got = fingerprint.likeness(one, {k: x[1:] for k, x in v.items()})
    assert got[0] == 1.0 and got[1] > got[2] > got[3]


# urls


def split_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest).group()
    path = re.match(r"[^?#]*", rest[len(host) :]).group()
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), path


def rule_of(host, path):
    fits = []
    for text in URL_RULES:
        verdict, target = text.split()
        rule_host, rest = target.split("/", 1)
        if (host == rule_host or host.endswith("." + rule_host)) and path.startswith("/" + rest):
            fits.append((len(target), target, verdict))
    return max(fits)[1:] if fits else (None, None)


def held_urls(rows, urls):
    for r in rows:
        host, path = split_url(urls[r["page_id"]])
        rule, verdict = rule_of(host, path)
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule)
        assert r["verdict"] in ("allow", "block") and (verdict is None or r["verdict"] == verdict)


def test_url_query(spark, small):
    urls = {r["page_id"]: r["url"] for r in spark.read.parquet(f"{small}/pages.parquet").collect()}
    rows = op9_url_filter(spark, small).collect()
    assert len(rows) == len(urls)
    held_urls(rows, urls)


ODD_URLS = [None, "", "no scheme", "http://", "HTTP://EXAMPLE.com", "http://example.com/en/x?y#z", "http://www.Example.COM/en/", "http://sub.www.example.com/en/a", "http://a.net/es/", "http://net/fr/", "http://badnet/es/", "x://y://z.com/a", "http://com?/", "http://É.com/a#b?c", "http://a.org/" + "p/" * 3000, "http://a.com/'`$\\"]


def test_odd_urls(spark):
    frame = spark.createDataFrame([(k, u) for k, u in enumerate(ODD_URLS)], "page_id long, url string").selectExpr("*", "'own' AS host", "'own' AS score")
    rules = [url_filter.rule(r) for r in URL_RULES]
    held_urls(url_filter.filter_urls(frame, rules).collect(), dict(enumerate(ODD_URLS)))
    assert url_filter.filter_urls(frame.limit(0), rules).collect() == []
    repeated = url_filter.filter_urls(frame.union(frame), rules)
    assert repeated.count() == 2 * len(ODD_URLS)


def test_trees_learn_held_out_urls(spark):
    def make(k):
        bad = k % 3 == 0
        return (f"http://shop{k % 7}.biz/{quote(prose(k, 6))}/{k * 7919}?a=1&b=2&c={k}" if bad else f"http://site{k % 5}.org/{prose(k, 2).replace(' ', '/')}", int(bad))

    frame = spark.createDataFrame([make(k) for k in range(600)], "url string, blocked int")
    host, path = url_filter.host_and_path(frame["url"])
    frame = frame.withColumns({"host": host, "path": path})
    model = url_filter.learn(frame.where("crc32(url) % 2 = 0"))
    scored = url_filter.blocked_probability(url_filter.lexical(frame.where("crc32(url) % 2 = 1")), model).select("blocked", "blocked_score").collect()
    assert np.mean([(r["blocked_score"] >= 0.5) == bool(r["blocked"]) for r in scored]) > 0.97


# quality


def test_sample_is_gumbel_top_k(spark, small):
    rows = op10_quality(spark, small).collect()
    assert len(rows) == spark.read.parquet(f"{small}/documents.parquet").count()
    keys = sorted((r["key"] for r in rows if r["key"] is not None), reverse=True)
    kept = [r["key"] for r in rows if r["kept"]]
    assert sorted(kept, reverse=True) == keys[: len(kept)] and 0 < len(kept) <= len(keys)


def test_labels_are_met(spark):
    folder = "/root/testdata/sf0.01"
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    kept = {r["doc_id"]: r["kept"] for r in op10_quality(spark, folder).collect()}
    good = [kept[i] for i, q in labels.items() if q == 1]
    bad = [kept[i] for i, q in labels.items() if q == 0]
    assert np.mean(good) > 0.97 and np.mean(bad) < 0.3


def test_weights_are_sums_of_log_ratios(spark):
    texts = ["Alpha beta, alpha", "beta", None, "", " "]
    ratio = np.random.default_rng(1).normal(size=quality.BUCKETS)
    got = [w for _, (weights,) in quality._weigh(ratio)(pa.array(texts)) for w in weights.to_pylist()]
    block = next(quality.bytesvec.blocks(pa.array(texts)))
    grams, bounds = quality._grams(block)
    assert bounds.tolist() == [0, 7, 8, 8, 8, 8]
    assert got[2:] == [None] * 3 and abs(got[0] - ratio[grams[:7]].sum()) < 1e-8


@pytest.mark.parametrize("k", [1, 7, 500, 999, 1000])
def test_kth_largest(spark, monkeypatch, k):
    monkeypatch.setattr(quality, "_FEW", 5)
    monkeypatch.setattr(quality, "_BINS", 8)
    values = [float(x % 400) / 7 for x in range(1000)]
    assert quality.kth_largest(spark.createDataFrame([(v,) for v in values], "key double"), k) == sorted(values, reverse=True)[k - 1]


def test_inclusion_follows_the_weights(spark):
    """Over seeds, the first of a sample is document i as often as its weight says, and samples differ."""
    weights = [0.0, 1.0, 2.0, -3.0]
    frame = spark.createDataFrame(list(enumerate(weights)), "doc_id long, w double")
    rows = frame.select(*(quality._key("w", seed).alias(f"k{seed}") for seed in range(1500))).collect()
    drawn = np.array([list(r) for r in rows]).argmax(axis=0)
    wanted = np.exp(weights) / np.exp(weights).sum()
    assert np.allclose(np.bincount(drawn, minlength=4) / 1500, wanted, atol=0.04)


def test_samples_of_a_share_differ_between_seeds(spark, small):
    docs, labels = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("documents", "labels"))
    rows = {seed: {r["doc_id"]: r for r in quality.classify_quality(docs, labels, seed, share=0.5).collect()} for seed in (1, 2)}
    kept = {seed: {i for i, r in found.items() if r["kept"]} for seed, found in rows.items()}
    present = sum(r["key"] is not None for r in rows[1].values())
    assert len(kept[1]) == len(kept[2]) == round(present / 2) and kept[1] != kept[2]
    plain = set(sorted((i for i, r in rows[1].items() if r["weight"] is not None), key=lambda i: -rows[1][i]["weight"])[: len(kept[1])])
    assert kept[1] != plain and len(kept[1] & plain) > 0.8 * len(plain)


def test_quality_of_awkward_rows(spark):
    docs = documents(spark, clash=("weight", "key", "_weight"))
    labels = spark.createDataFrame([(1, 1, 0), (12, 1, 0), (2, 1, 0), (16, 0, 0), (17, 0, 0), (None, 1, 0), (4, None, 1)], "doc_id long, quality int, toxic int")
    rows = quality.classify_quality(docs, labels).collect()
    assert len(rows) == docs.count()
    assert not any(r["kept"] for r in rows if r["doc_id"] in (6, 7, 8))
    kept = quality.good_documents(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(r["kept"] for r in rows)
    unlabelled = quality.classify_quality(docs, labels.limit(0)).collect()
    assert all(r["kept"] == (r["weight"] is not None) for r in unlabelled)
    assert quality.classify_quality(nothing(spark), labels).collect() == []
    assert quality.good_documents(nothing(spark), labels.limit(0)).collect() == []
