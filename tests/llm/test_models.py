"""Learned operators by held-out accuracy, tokenizer parity, page text, image copies and the pipeline."""

import itertools
import math
import random
import re
from html.parser import HTMLParser

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from linespark.sources import shared
from linespark.llm import languages, media, mixing, pages, queries, sentencepieces, toxicity

SF = "/root/testdata/sf0.001"


# ----------------------------------------------------------------- languages


def best_path(scores, switch):
    best = max(itertools.product(range(scores.shape[1]), repeat=len(scores)), key=lambda p: sum(scores[t, x] for t, x in enumerate(p)) - switch * sum(a != b for a, b in itertools.pairwise(p)))
    return sum(scores[t, x] for t, x in enumerate(best)) - switch * sum(a != b for a, b in itertools.pairwise(best))


@pytest.mark.parametrize("seed", range(20))
def test_viterbi_is_optimal(seed):
    scores = -np.random.default_rng(seed).random((7, 3)) * 4
    for switch in (0.0, 1.0, 3.0, 9.0):
        path = languages.viterbi(scores, switch)
        value = scores[np.arange(7), path].sum() - switch * (path[1:] != path[:-1]).sum()
        assert value == pytest.approx(best_path(scores, switch))


def test_viterbi_may_leave_the_best_single_label():
    scores = np.array([[0.0, -8, -2]] * 5 + [[-8.0, 0, -2]] * 5)
    assert languages.viterbi(scores, 12.0).tolist() == [0] * 5 + [1] * 5
    assert languages.viterbi(np.zeros((4, 1)), 12.0).tolist() == [0] * 4


def test_language_accuracy_spans_and_odd_rows(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = languages.learn(docs.filter(~languages.held_out()))
    rows = languages.identify(docs.filter(languages.held_out()).select("doc_id", "text", "lang"), model).collect()
    assert np.mean([r.lang_pred == r.key.lang for r in rows]) > 0.95 and all(0 <= r.score <= 1 for r in rows)
    text = {r.lang: r.text for r in docs.filter("lang in ('en', 'fr') and length(text) > 400").collect()}
    mixed = text["en"][:400] + " " + text["fr"][:200]
    odd = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (3, "123 !?", "x"), (4, "привет мир", "x"), (5, mixed, "x"), (6, text["fr"] * 300, "x")], "doc_id long, text string, score string")
    out = {r.key.doc_id: r for r in languages.identify(odd, model).collect()}
    assert [(out[i].lang_pred, out[i].score) for i in (1, 2, 3)] == [("und", 0.0)] * 3
    assert out[4].lang_pred in model.names and out[6].lang_pred == "fr"
    spans = out[5].spans
    assert [s.lang for s in spans] == ["en", "fr"] and 380 <= spans[1].begin <= 420 and out[5].key.score == "x"
    assert languages.identify(spark.createDataFrame([], odd.schema), model).count() == 0


def test_languages_of_null_ids_repeated_rows_and_ties(spark):
    letters = {"xx": "abcd", "yy": "abcd", "zz": "mnop"}
    rows = [(i, " ".join(letters[k] * 5 for _ in range(20)), k) for i, k in enumerate(letters)] + [(None, "qrst " * 30, "null id"), (2, letters["zz"] * 30, "zz")]
    model = languages.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.names == ["xx", "yy", "zz"]
    odd = spark.createDataFrame([(None, "abcdabcd", "k"), (1, "abcd abcd", "k"), (1, "abcd abcd", "k"), (2, "mnop", "k")], "doc_id long, text string, key string")
    out = languages.identify(odd.withColumn("held_out", languages.held_out()), model).collect()
    # Equal languages tie; the first by name gets the text.
    assert sorted((str(r.key.doc_id), r.lang_pred) for r in out) == [("1", "xx"), ("1", "xx"), ("2", "zz"), ("None", "xx")]
    assert [r.key.held_out for r in out if r.key.doc_id is None] == [False] and {r.key.key for r in out} == {"k"}


def test_nothing_learned_means_undetermined(spark):
    model = languages.learn(spark.createDataFrame([(1, "text", None)], "doc_id long, text string, lang string"))
    row = languages.identify(spark.createDataFrame([(1, "text")], "doc_id long, text string"), model).first()
    assert (row.lang_pred, row.score) == ("und", 0.0)


# ------------------------------------------------------------------ toxicity


def toxic_rows(seed, n=1200):
    rng = random.Random(seed)
    clean, bad = [f"w{i}" for i in range(300)], ["grobian", "stinker", "lumpen"]
    docs, labels = [], []
    for i in range(n):
        words = rng.choices(clean, k=rng.randrange(20, 80))
        toxic = i % 8 == 0
        for _ in range(3 * toxic):
            words[rng.randrange(len(words))] = rng.choice(["you " + rng.choice(bad), rng.choice(bad).upper() + "!", rng.choice(bad).replace("i", "1") + "y"])
        docs.append((i, " ".join(words)))
        labels.append((i, int(toxic)))
    return docs, labels


def test_toxicity_on_held_out_rows(spark):
    docs, labels = toxic_rows(3)
    d, truth = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")
    model = toxicity.learn(d.filter(~languages.held_out()), truth)
    rows = toxicity.score(d.filter(languages.held_out()), model).collect()
    found = {r.key.doc_id: r.score >= 0.3 for r in rows}
    wrong = sum(found[i] != (i % 8 == 0) for i in found)
    assert wrong / len(found) < 0.03 and all(0 <= r.score <= 1 for r in rows)
    odd = toxicity.score(spark.createDataFrame([(None, None, 1.0), (2, "", 1.0), (3, "w1 " * 50_000, 1.0)], "doc_id long, text string, score double"), model).collect()
    assert len(odd) == 3 and odd[0].score == odd[1].score


def test_toxicity_without_both_classes(spark):
    d = spark.createDataFrame([(1, "a"), (2, "b")], "doc_id long, text string")
    model = toxicity.learn(d, spark.createDataFrame([(1, 1), (1, 0), (None, 1)], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(d, model).collect()] == [1.0, 1.0]
    none = toxicity.learn(d, spark.createDataFrame([], "doc_id long, toxic int"))
    assert [r.score for r in toxicity.score(d, none).collect()] == [0.0, 0.0]


def test_toxicity_of_repeated_rows_and_empty_tables(spark):
    docs, labels = toxic_rows(5, 400)
    d, truth = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels * 2, "doc_id long, toxic int")
    model = toxicity.learn(d, truth)
    rows = toxicity.score(d.limit(20).unionByName(d.limit(20)), model).collect()
    assert len(rows) == 40 and len({(r.key.doc_id, r.score) for r in rows}) == 20
    assert toxicity.score(d.limit(0), model).count() == 0
    none = toxicity.learn(d.limit(0), truth)
    assert {r.score for r in toxicity.score(d.limit(3), none).collect()} == {0.0}


@pytest.mark.parametrize("word,expected", [("St1nk3r!", ("stinker", True)), ("plain,", ("plain", False)), ("it's", ("it's", False)), ("42", ("42", False)), ("###", ("", False))])
def test_words_are_read_plainly(word, expected):
    assert toxicity.plain(word) == expected


# -------------------------------------------------------------------- mixing


def test_rates_reach_the_targets_like_a_direct_solution(spark):
    rng = np.random.default_rng(2)
    share = np.round(rng.dirichlet([0.4, 0.4, 0.4], 300), 2)
    share[:, 2] = np.round(1 - share[:, 0] - share[:, 1], 2)
    tokens = rng.integers(1, 500, 300)
    members = spark.createDataFrame([((i,), int(t), [float(x) for x in s]) for i, (t, s) in enumerate(zip(tokens, share, strict=True))], "key struct<doc_id:long>, n_tokens long, posterior array<double>")
    domains = mixing.Domains(["a", "b", "c"], np.ones(3) / 3, np.zeros((1, 3)))
    fit = mixing.fit_rates(members, domains, {"a": 5, "b": 3, "c": 2}, 1.2, steps=400)
    rows = sorted(mixing.with_rates(members, fit, domains).collect(), key=lambda r: r.key.doc_id)
    rate = np.array([r.rate for r in rows])
    reached = (share * (tokens * rate)[:, None]).sum(axis=0) / tokens.sum()
    assert rate.min() >= 0 and np.abs(reached - 1.2 * np.array([0.5, 0.3, 0.2])).max() < 0.01
    # Plain projected gradient on all rows at once.
    r = np.full(300, 1.2)
    for _ in range(20_000):
        gap = (share * (tokens * r)[:, None]).sum(axis=0) / tokens.sum() - 1.2 * np.array([0.5, 0.3, 0.2])
        r = np.maximum(0, r - share @ gap - mixing.PULL * (r - 1.2))
    assert np.abs(r - rate).max() < 0.02


def test_rare_domains_reach_their_targets(spark):
    """A domain with a thousandth of the tokens gets its share as exactly as the large ones."""
    tokens = {"big": 899_000, "mid": 100_000, "rare": 1000}
    members = spark.createDataFrame([((i,), n // 10, [float(d == name) for d in tokens]) for i, (name, n) in enumerate((k, v) for k, v in tokens.items() for _ in range(10))], "key struct<doc_id:long>, n_tokens long, posterior array<double>")
    domains = mixing.Domains(list(tokens), np.ones(3) / 3, np.zeros((1, 3)))
    fit = mixing.fit_rates(members, domains, {"big": 0.9, "mid": 0.098, "rare": 0.002})
    rows = mixing.with_rates(members, fit, domains).collect()
    reached = np.sum([np.array(r.posterior) * r.n_tokens * r.rate for r in rows], axis=0) / 1_000_000
    assert np.abs(reached / [0.9, 0.098, 0.002] - 1).max() < 0.005


def test_mixing_of_repeated_long_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "apple pear " * 50_000), (2, "iron zinc"), (2, "iron zinc"), (3, "iron"), (4, "apple")], "doc_id long, text string")
    domains = mixing.learn(docs, spark.createDataFrame([(3, "metal"), (4, "fruit"), (4, "metal")], "doc_id long, domain string"))
    members = mixing.memberships(docs, domains)
    rows = mixing.with_rates(members, mixing.fit_rates(members, domains, {"fruit": 1.0, "metal": 1.0}), domains).collect()
    assert sorted(r.n_tokens for r in rows) == [1, 1, 2, 2, 100_000] and len({(tuple(r.posterior), r.rate) for r in rows if r.key.doc_id == 2}) == 1
    none = docs.limit(0)
    assert mixing.with_rates(mixing.memberships(none, domains), mixing.fit_rates(mixing.memberships(none, domains), domains, {"fruit": 1.0}), domains).count() == 0


def test_mixing_carries_columns_of_its_own_names(spark):
    docs = spark.createDataFrame([(i, "apple pear" if i % 2 else "iron zinc", f"p{i}", i, -1.0, "k") for i in range(8)], "doc_id long, text string, posterior string, n_tokens int, rate double, key string")
    domains = mixing.learn(docs, spark.createDataFrame([(0, "metal"), (1, "fruit")], "doc_id long, domain string"))
    members = mixing.memberships(docs, domains)
    rows = mixing.with_rates(members, mixing.fit_rates(members, domains, {"fruit": 1.0, "metal": 1.0}), domains).collect()
    assert sorted((r.key.doc_id, r.key.posterior, r.key.n_tokens, r.key.rate, r.key.key, r.n_tokens) for r in rows) == [(i, f"p{i}", i, -1.0, "k", 2) for i in range(8)]


def test_memberships_and_odd_rows(spark):
    docs = spark.createDataFrame([(i, ("apple pear plum " if i % 2 else "iron steel zinc ") * 20) for i in range(40)] + [(100, None), (101, ""), (None, "apple iron")], "doc_id long, text string")
    domains = mixing.learn(docs, spark.createDataFrame([(i, "fruit" if i % 2 else "metal") for i in range(30)] + [(None, "x"), (5, None)], "doc_id long, domain string"))
    rows = {r.key.doc_id: r for r in mixing.memberships(docs, domains).collect()}
    assert domains.names == ["fruit", "metal"] and rows[33].posterior == [1.0, 0.0] and rows[34].posterior == [0.0, 1.0]
    assert rows[100].n_tokens == rows[101].n_tokens == 0 and rows[100].posterior == rows[101].posterior == [0.5, 0.5]
    assert all(sum(r.posterior) == pytest.approx(1) for r in rows.values()) and rows[None].n_tokens == 2
    unknown = mixing.learn(docs, spark.createDataFrame([], "doc_id long, domain string"))
    fit = mixing.fit_rates(mixing.memberships(docs, unknown), unknown, {"a": 1.0}, 1.5)
    assert {r.rate for r in mixing.with_rates(mixing.memberships(docs, unknown), fit, unknown).collect()} == {1.5}


def test_copies_have_the_rate_as_mean(spark):
    got = spark.range(4000).select(mixing.copies(F.lit(1.3), "id").alias("c")).agg(F.avg("c"), F.min("c"), F.max("c")).first()
    assert abs(got[0] - 1.3) < 0.03 and (got[1], got[2]) == (1, 2)


# ------------------------------------------------------------- sentencepiece

ODD = ["", " ", "  a", "a  b", "a\n\n b ", "       x" * 5, " " * 40, "日本語 テスト", "🙂 emoji<s></s><0x41>", "▁x ▁▁y", "\t tab", "é" * 10, "a" * 300, " \n", "x" + " " * 20 + "y", "\r\n\x00\x7f", "ﬁ ½"]


def unigram_model():
    """A small model of the unigram kind, written by hand."""
    def field(number, value):
        size = len(value)
        head = bytes([number << 3 | 2])
        while size > 127:
            head, size = head + bytes([size & 127 | 128]), size >> 7
        return head + bytes([size]) + value

    import struct

    kinds = [("<unk>", 0.0, 2)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256)]
    kinds += [(p, s, 1) for p, s in [("▁", -3.0), ("a", -4.0), ("b", -4.5), ("c", -5.0), ("ab", -5.5), ("▁ab", -6.0), ("bc", -6.1), ("▁a", -5.2), ("abc", -9.0)]]
    data = b"".join(field(1, field(1, p.encode()) + b"\x15" + struct.pack("<f", s) + bytes([0x18, k])) for p, s, k in kinds)
    return data + field(2, bytes([0x18, 1]) + b"\x98\x02\x01") + field(3, field(1, b"identity") + b"\x18\x01\x20\x00")


@pytest.mark.parametrize("model", ["pairs", "unigram"])
def test_tokenizer_parity(model):
    import sentencepiece

    data = open(sentencepieces.MODEL_PATH, "rb").read() if model == "pairs" else unigram_model()
    original = sentencepiece.SentencePieceProcessor(model_proto=data)
    codec = sentencepieces.Codec(data, 2, True)
    texts = ODD if model == "pairs" else ["abc ab a", "abcabc", "", "x ab", "a  b", "é"]
    found, same = codec.encode(texts)
    ids = [np.frombuffer(f, np.int32).tolist() for f in found]
    assert ids == original.encode(texts) and all(same)
    assert codec.decode(ids) == [original.decode(i) for i in ids]


def test_literal_markers_beside_spaces():
    import sentencepiece

    data = open(sentencepieces.MODEL_PATH, "rb").read()
    original = sentencepiece.SentencePieceProcessor(model_proto=data)
    rng = random.Random(8)
    texts = ["▁ ▂ ▃ ▁ ▁", "trend ▁▂▁ ▁ end", *("".join(rng.choices(["▁", " ", "▂", "the", "a", "\n", "é"], k=rng.randint(1, 40))) for _ in range(2000))]
    found, same = sentencepieces.Codec(data, 2, True).encode(texts)
    assert [np.frombuffer(f, np.int32).tolist() for f in found] == original.encode(texts) and all(same)


def test_parity_is_held_against_whole_texts():
    codec = sentencepieces.Codec(open(sentencepieces.MODEL_PATH, "rb").read(), 2, True)
    codec.cut = lambda text: list(text)
    assert codec.encode(["two words", ""])[1] == [False, True]


def test_encode_and_decode_rows(spark):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate([None, *ODD, "word " * 60_000])], "doc_id long, text string, parity string")
    rows = sentencepieces.encode(df)
    back = {r.key.key.doc_id: r.text for r in sentencepieces.decode(rows.select("key", "token_ids")).collect()}
    assert back == {i: t.replace("▁", " ") if t else t for i, t in enumerate([None, *ODD, "word " * 60_000])}
    assert all(r.parity is r.round_trip is (None if r.key.doc_id == 0 else True) for r in rows.collect())
    assert sentencepieces.encode(df.limit(0)).count() == 0


def test_tokens_of_null_ids_and_repeated_rows(spark):
    df = spark.createDataFrame([(None, "two words"), (1, "two words"), (1, "two words"), (2, None)], "doc_id long, text string")
    rows = sentencepieces.encode(df).collect()
    assert len(rows) == 4 and len({tuple(r.token_ids) for r in rows if r.token_ids is not None}) == 1
    assert [r.n_tokens for r in rows if r.key.doc_id == 2] == [None]


# --------------------------------------------------------------------- pages

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var t="</p>";</script></head><body>
<header>site</header><nav><ul><li><a href="/">Menu</a></li></ul></nav><!-- ad --><div class="ad">Buy</div>
<article><header><h1>Title &amp; more</h1></header><p><b>one<br><p>t<i>w</i>o&nbsp; three<ul><li>x<li>y</ul><div class='reader comments'><p>no</div>
<form><input>f</form><aside>s</aside><p>a < b &lt;c&gt;<div id="cookie-notice">n</div><p hidden>h</p><p>end</p><footer>f</footer></article><footer>&copy;</footer></body></html>"""


def test_main_text_of_an_article():
    assert pages.main_text(PAGE) == "Title & more one two three x y a < b <c> end"


@pytest.mark.parametrize("source,text", [(None, ""), ("", ""), ("plain", "plain"), ("<p>a<p>b<p unfinished", "a b"), ("<body><nav>n", ""), ("<article>x &am", "x &am"), ("<script>a</article>", ""), ("<article>a<br/>b<span>c</span></article>", "a bc")])
def test_main_text_edges(source, text):
    assert pages.main_text(source) == text


def test_style_tree_removes_low_nodes_without_roles(spark):
    words = [f"w{i}" for i in range(500)]
    rng = random.Random(1)
    body = lambda i: f"<div class=top><p>Site name and slogan</p></div><div class=links><a href=1>{words[i]}</a> <a href=2>{words[i + 9]}</a></div><div class=story>" + "".join(f"<p>{' '.join(rng.choices(words, k=20))}</p>" for _ in range(1 + i % 4)) + f"</div><div class=bottom>All rights {'' if i % 2 else 'reserved'}</div>"
    rows = [(i, f"http://one.example/{i}", body(i)) for i in range(40)] + [(100, "http://two.example/", body(1)), (101, None, None), (102, "http://one.example/x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    out = {r.key.page_id: r for r in pages.extract(df.withColumn("text", F.lit("own"))).collect()}
    for i in range(40):
        assert "slogan" not in out[i].text and "rights" not in out[i].text and out[i].n_chars == len(out[i].text) and len(out[i].text.split()) == 20 * (1 + i % 4)
    assert "slogan" in out[100].text and out[101].text == out[102].text == "" and out[0].key.text == "own"
    copies = spark.createDataFrame([(i, "http://c.example/", "<div>same page</div>") for i in range(30)], "page_id long, url string, html string")
    assert {r.text for r in pages.extract(copies).collect()} == {"same page"}
    assert pages.extract(df.limit(0)).count() == 0


class PlainPage(HTMLParser):
    """Blocks (path, text, linked, core, named) of a well-formed page, by a parser of its own."""

    NAMED = {"ad box": (0.8, 0.8), "notice": (0.8, 0.5)}

    def __init__(self, source):
        super().__init__()
        self.stack, self.found, self.fresh = [], [], True
        self.feed(source or "")

    def handle_starttag(self, tag, attributes):
        names = dict(attributes).get("class") or ""
        words = sorted({w for w in re.split(r"[^a-z]+", names) if w})
        self.stack.append((tag, f"{tag}.{'.'.join(words)}", self.NAMED.get(names)))
        self.fresh |= tag != "a"

    def handle_endtag(self, tag):
        self.stack.pop()
        self.fresh |= tag != "a"

    def handle_data(self, text):
        core = any(t == "article" for t, _, _ in self.stack)
        if self.fresh:
            path = tuple(s for t, s, _ in self.stack if t != "a")
            named = max([0, *(n[core] for _, _, n in self.stack if n)])
            self.found.append([path, "", 0, core, named])
            self.fresh = False
        self.found[-1][1] += text
        self.found[-1][2] += len(text) if any(t == "a" for t, _, _ in self.stack) else 0


def tree_by_hand(rows):
    """Importances of each host's nodes and the main text of each page by plain loops: [(host, html)]."""
    sites = {}
    parsed = [PlainPage(source).found for _, source in rows]
    for (host, _), found in zip(rows, parsed, strict=True):
        if found:
            longest = max(len(b[1]) for b in found)
            sites.setdefault(host, {}).setdefault(next(b[1] for b in found if len(b[1]) == longest), []).append(found)
    importance, shared, low, cut = {}, {}, {}, {}
    for host, by_page in sites.items():
        m = len(by_page)
        size = inner = 0
        nodes = {}
        for page, copies in by_page.items():
            for b in {(b[0], b[1]): b for found in copies for b in found}.values():
                nodes.setdefault(b[0], []).append((b[1], page, b))
                size += len(b[1])
                inner += len(b[1]) * b[3]
        for path, own in nodes.items():
            pages_of = {}
            for text, page, _ in own:
                pages_of.setdefault(text, set()).add(page)
            letters = sum(len(t) for t, _, _ in own)
            content = sum(len(t) * (1 - math.log(len(pages_of[t])) / math.log(m + 4)) for t, _, _ in own) / letters
            shapes = {(page, sum(b[0] == path for b in found)) for page, copies in by_page.items() for found in copies if any(b[0] == path for b in found)}
            counts = [sum(n == k for _, n in shapes) for k in {n for _, n in shapes}]
            entropy = -sum(c / len(shapes) * math.log(c / len(shapes)) for c in counts) / math.log(m + 4)
            links = sum(0 if b[3] else b[2] for _, _, b in own) / letters
            inside = sum(len(t) * b[3] for t, _, b in own) / letters
            named = sum(len(t) * b[4] for t, _, b in own) / letters
            importance[host, path] = (0.9 * content + 0.1 * entropy) * (1 - links) * (1 - 0.74 * (1 - inside) * inner / size) * (1 - named)
            shared[host, path] = len(shapes) > 1
        at = [0.15, *sorted(v for (h, p), v in importance.items() if h == host and shared[h, p] and 0.15 <= v <= 0.35), 0.35]
        widest = max(b - a for a, b in zip(at, at[1:], strict=False))
        cut[host] = next((a + b) / 2 for a, b in zip(at, at[1:], strict=False) if b - a == widest) if any(shared[h, p] for h, p in shared if h == host) else 0.25
        low |= {(h, p): v < cut[host] for (h, p), v in importance.items() if h == host}
    texts = [" ".join(b[1] for b in found if not low[host, b[0]]) for (host, _), found in zip(rows, parsed, strict=True)]
    return importance, {k for k, gone in low.items() if gone and shared[k]}, cut, texts


def test_importance_equals_plain_loops(spark):
    """Nodes, thresholds and texts against a parser and loops that share nothing with the operator."""
    rng = random.Random(6)
    words = [f"w{i}" for i in range(80)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    rows = []
    for i in range(60):
        parts = [f"<div class=top>{rng.choice(['Welcome', 'Hello there'])}</div>", f"<div class='ad box'>{say(3)}</div>", f"<ul class=links{i}><li><a href=x>{say(2)}</a> and {say(1)}</li></ul>"]
        parts += [f"<{'article' if i % 3 else 'div class=story'}>" + "".join(f"<p>{say(9)}</p>" for _ in range(1 + i % 4)) + f"<h2>Summary</h2><h2>{say(5)}</h2><p class=notice>{say(6)}</p><p class=legal>Printed in 2020</p>" + f"</{'article' if i % 3 else 'div'}>"]
        rows.append((i, f"http://h{i % 4 if i < 50 else 4}.example/{i}", "".join(parts)))
    rows += [(100 + i, *rows[0][1:]) for i in range(3)] + [(200, rows[1][1], rows[1][2].replace("Welcome", "Bye")), (201, None, "<p>no host</p>"), (202, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    nodes = [r for r in pages.style_trees(pages.merged_trees(df)).collect() if not r.host.startswith("page:")]
    importance, low, cut, texts = tree_by_hand([(u.split("/")[2], h) for _, u, h in rows if u])
    for host in cut:
        ours, theirs = (sorted(x) for x in ([r.importance for r in nodes if r.host == host], [v for (h, _), v in importance.items() if h == host]))
        assert len(ours) == len(theirs) and all(abs(a - b) < 1e-9 for a, b in zip(ours, theirs, strict=True))
    found = {r.site: r for r in pages.removals(df).collect() if not r.site.startswith("page:")}
    assert {h: len(r.low or ()) for h, r in found.items()} == {h: sum(x == h for x, _ in low) for h in cut}
    assert all(abs(found[h].threshold - cut[h]) < 1e-9 for h in cut)
    out = {r.key.page_id: r.text for r in pages.extract(df).collect()}
    assert [out[i] for i, u, _ in rows if u] == texts and out[201] == "no host" and out[202] == ""
    assert all("Summary" in t for i, t in out.items() if i < 60 and i % 3)


def test_entropy_decides_within_articles(spark):
    """Without the tree the same pages give other texts: it removes what repeats and keeps what differs, whatever its name."""
    say = lambda name, i: " ".join(f"{name}{i}x{k}" for k in range(12))
    page = lambda i: f"<article><p>{say('body', i)}</p><div class=promo>{say('promo', i)}</div><p class=note>Sign the letter of the week</p><p class=notice>Prices include tax</p></article><div class=rail>{''.join(f'<p>{say(f'rail{k}', i)}</p>' for k in range(1 + i % 7))}</div>"
    rows = [(i, f"http://one.example/{i}", page(i)) for i in range(40)]
    out = {r.key.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i, _, source in rows:
        assert out[i].startswith(f"{say('body', i)} {say('promo', i)}") and "letter of the week" not in out[i] and "include tax" not in out[i]
        assert "letter of the week" in pages.main_text(source) and "include tax" in pages.main_text(source)
    assert all(f"rail0{i}x0" in out[i] for i in out)
    # In an article the names of roles with other meanings don't decide alone.
    for name, tag in (("notice", "p"), ("header", "p"), ("promo", "div"), ("social", "div"), ("comment", "p")):
        assert pages.main_text(f"<article><p>Body</p><{tag} class={name}>The text stays.</{tag}></article>") == "Body The text stays."
    assert pages.main_text("<article><p>Body</p><div class='user-opinions'>No</div><ol class=thread><li>no</ol></article><div class=promo>no</div>") == "Body"


def test_classes_made_for_each_page_are_not_sent(spark):
    rows = [(i, "http://one.example/", f"<article><p class=a{'bcdefghijk'[i]}{'xyz'[i % 3] * (i + 1)}>text {i}</p></article><div class=ad>buy {i}</div>") for i in range(10)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 low", "2 high", "'c' host", "3 article")
    out = pages.extract(df).select("key.*", "text").collect()
    assert all(r.text == f"text {r.page_id}" and (r.low, r.high, r.host, r.article) == (1, 2, "c", 3) for r in out)
    (site,) = pages.removals(df).collect()
    assert len(site.low) + len(site.high) == 1


def test_main_text_beside_teasers_and_under_odd_names(spark):
    say = lambda i: " ".join(f"s{i}x{k}" for k in range(60))
    inside = lambda i: f"<h2 class=related-work>Related work {i}</h2><p class=share-price>Shares rose {i}</p><div id=login-flow>Log in first {i}</div><p class='alert-level'>Level two {i}</p>"
    rows = [(i, f"http://a.example/{i}", f"<body><div class='site has-sidebar'><form action=x><div class=story>{say(i)}</div><article>Teaser one</article><article>Teaser two</article></form></div>") for i in range(12)]
    rows += [(100 + i, f"http://b.example/{i}", f"<form class=page><article><p>{say(100 + i)}</p>{inside(i)}<div class=comments><p>reader {i} says much more than the article, {say(i)} {say(i)}</p></div><ul><li><a href=1>source {i}</a></ul></article></form>") for i in range(9)]
    out = {r.key.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for i in range(12):
        assert out[i] == say(i)
    for i in range(9):
        assert "reader" not in out[100 + i] and out[100 + i].startswith(say(100 + i)) and out[100 + i].endswith(f"source {i}")
        assert all(t in out[100 + i] for t in ("Related work", "Shares rose", "Log in first", "Level two"))
    assert say(1) in pages.main_text(rows[1][2])


@pytest.mark.parametrize("source", ["<b>" * 50_000 + "x" + "</i>" * 50_000, "<p>" + "<b>" * 50_000 + "<div>" + "<i>" * 50_000 + "<p>y" * 50_000, "<div class=ad>" * 50_000 + "x", "<p><i>" * 50_000 + "x", "<a title='" * 50_000])
def test_odd_pages_take_linear_time(source):
    import time

    began = time.process_time()
    pages.blocks(source)
    assert time.process_time() - began < 10


# --------------------------------------------------------------------- media


def png(grey):
    import struct
    import zlib

    height, width = grey.shape
    raw, before = b"", np.zeros(width, np.uint8)
    for y, row in enumerate(grey):
        kind = y % 3
        left = np.r_[np.uint8(0), row[:-1]]
        raw += bytes([kind]) + (row if kind == 0 else row - left if kind == 1 else row - before).astype(np.uint8).tobytes()
        before = row
    chunk = lambda kind, data: struct.pack(">I", len(data)) + kind + data + b"\0\0\0\0"
    return b"\x89PNG\r\n\x1a\n" + chunk(b"IHDR", struct.pack(">IIBBBBB", width, height, 8, 0, 0, 0, 0)) + chunk(b"IDAT", zlib.compress(raw)) + chunk(b"IEND", b"")


def test_formats():
    grey = np.random.default_rng(1).integers(0, 256, (20, 31)).astype(np.uint8)
    assert (media.decode(media.encode_pgm(grey)) == grey).all() and (media.decode(png(grey)) == grey).all()
    assert media.decode(b"P6\n# c\n1 1\n255\n\x10\x10\x10")[0, 0] == pytest.approx(16)
    assert all(media.decode(x) is None for x in (None, b"", b"P5\n9 9\n255\n", b"\x89PNG\r\n\x1a\nxx", b"GIF89a"))


def test_copies_are_found_and_others_left_apart(spark):
    rng = np.random.default_rng(4)
    images = [np.kron(rng.integers(0, 256, (24, 24)), np.ones((4, 4))) for _ in range(12)]
    rows = [(i, media.encode_pgm(x)) for i, x in enumerate(images)]
    rows += [(100, media.encode_pgm(images[3][9:, 5:] * 0.8 + 20)), (101, media.encode_pgm(np.rot90(images[5]))), (102, rows[7][1]), (103, None), (104, b"no image"), (105, media.encode_pgm(np.zeros((96, 96)))), (None, rows[7][1]), (106, None)]
    df = spark.createDataFrame(rows, "image_id long, media binary").withColumn("class_id", F.lit("x"))
    out = [(r.image_id, r.class_id) for r in media.copy_classes(df).collect()]
    assert len(out) == len(rows) and dict(out)[None] == 7
    assert {i: c for i, c in out if i is not None} == {**{i: i for i in range(12)}, 100: 3, 101: 5, 102: 7, 103: 103, 104: 104, 105: 105, 106: 106}
    assert media.copy_classes(df.limit(0)).count() == 0


def smooth_image(rng, side):
    """Random low frequencies: no edges, so corners are weak."""
    frequency = np.hypot(*np.meshgrid(np.fft.fftfreq(side), np.fft.fftfreq(side))) * side
    grey = np.real(np.fft.ifft2(np.fft.fft2(rng.normal(0, 1, (side, side))) * np.exp(-((frequency / 14) ** 2))))
    return np.clip(127 + 50 * (grey - grey.mean()) / grey.std(), 0, 255)


def warped(image, turn, scale):
    h, w = image.shape
    y, x = np.mgrid[: int(h * scale), : int(w * scale)]
    z = ((x - (int(w * scale) - 1) / 2) + 1j * (y - (int(h * scale) - 1) / 2)) * np.exp(-1j * np.radians(turn)) / scale
    x, y = np.clip(z.real + (w - 1) / 2, 0, w - 1.001), np.clip(z.imag + (h - 1) / 2, 0, h - 1.001)
    a, b, u, v = y.astype(int), x.astype(int), y % 1, x % 1
    return image[a, b] * (1 - u) * (1 - v) + image[a, b + 1] * (1 - u) * v + image[a + 1, b] * u * (1 - v) + image[a + 1, b + 1] * u * v


EDITS = {
    "crop": lambda rng, x: x[len(x) // 8 :, len(x) // 6 : -len(x) // 10],
    "noise": lambda rng, x: x + rng.normal(0, 8, x.shape),
    "gamma": lambda rng, x: 255 * (x / 255) ** 1.5,
    "blur": lambda rng, x: media._box(x[None], 1)[0] / 9,
    "turn": lambda rng, x: warped(x, 15, 1)[24:-24, 24:-24],
    "three quarters": lambda rng, x: warped(x, 0, 0.75),
    "half": lambda rng, x: warped(x, 0, 0.5),
}


def test_recall_of_edits(spark):
    """Each edited copy is found, in a table with all edits at once; images of one source stand apart from the others."""
    rng = np.random.default_rng(0)
    rows = []
    for i in range(12):
        image = smooth_image(rng, 192)
        rows += [(100 * i, media.encode_pgm(image)), *((100 * i + 1 + k, media.encode_pgm(edit(rng, image))) for k, edit in enumerate(EDITS.values()))]
    df = spark.createDataFrame(rows, "image_id long, media binary")
    found = media.links(media.matches(df.mapInArrow(media._descriptors, "image_id long, place long, bits binary").withColumn("known", F.col("image_id")))).collect()
    direct = {(r.a, r.b) for r in found}
    for k, name in enumerate(EDITS):
        assert sum((100 * i, 100 * i + 1 + k) in direct for i in range(12)) >= 11, name
    out = {r.image_id: r.class_id for r in media.copy_classes(df).collect()}
    assert all(c == i // 100 * 100 for i, c in out.items())


def test_many_copies_and_images_that_share_corners(spark):
    """A source with very many copies stays one class though each descriptor meets few others; a shared logo links nothing."""
    rng = np.random.default_rng(1)
    source = np.kron(rng.integers(0, 256, (24, 24)), np.ones((4, 4)))
    logo = np.kron(rng.integers(0, 256, (9, 9)), np.ones((4, 4)))
    rows = [(i, media.encode_pgm(source + rng.normal(0, 3, source.shape))) for i in range(150)]
    for i in range(60):
        image = np.kron(rng.integers(0, 256, (24, 24)), np.ones((4, 4)))
        image[:36, :36] = logo
        rows += [(1000 + 2 * i, media.encode_pgm(image)), (1001 + 2 * i, media.encode_pgm(image[2:, 3:] * 0.8 + 20))]
    out = {r.image_id: r.class_id for r in media.copy_classes(spark.createDataFrame(rows, "image_id long, media binary")).collect()}
    assert {out[i] for i in range(150)} == {0}
    assert sum(out[1001 + 2 * i] == 1000 + 2 * i for i in range(60)) >= 54 and all(out[1000 + 2 * i] == 1000 + 2 * i for i in range(60))


def near_descriptors(rng):
    """Descriptors 0 to 20 bits apart: many groups of few, and one of very many that are nearly all of one class."""
    base = np.repeat(rng.integers(0, 2, (200, 128)), 8, axis=0)
    hot = np.repeat(rng.integers(0, 2, (1, 128)), 1400, axis=0)
    bits = np.concatenate([base, hot]).astype(np.uint8)
    for row in bits:
        row[rng.choice(128, rng.integers(0, 11), replace=False)] ^= 1
    known = np.r_[rng.integers(0, 300, len(base)), np.where(np.arange(len(hot)) % 100 == 0, 1000 + np.arange(len(hot)), 999)]
    return np.packbits(bits, axis=1), known


@pytest.mark.parametrize("cell_rows", [40, 250_000])
def test_all_matches_of_different_classes_are_found_once(spark, monkeypatch, cell_rows):
    """By brute force over all pairs; with small cells too, so that hot ones are dealt over several."""
    bits, known = near_descriptors(np.random.default_rng(5))
    words = bits.view(np.uint64)
    rows = [(i, 7 * i, bits[i].tobytes(), int(known[i])) for i in range(len(bits))]
    monkeypatch.setattr(media, "CELL_ROWS", cell_rows, raising=False)
    found = media.matches(spark.createDataFrame(rows, "image_id long, place long, bits binary, known long").repartition(3)).collect()
    out = [(r.a, r.b, r.pa, r.pb) for r in found]
    expected = set()
    for i in range(len(bits)):
        near = np.flatnonzero((np.bitwise_count(words[i + 1 :] ^ words[i]).sum(axis=1) <= 16) & (known[i + 1 :] != known[i])) + i + 1
        expected |= {(i, j, 7 * i, 7 * j) for j in near.tolist()}
    assert len(expected) > 20_000 and len(out) == len(set(out)) and set(out) == expected


def test_more_blocks_of_images_send_and_keep_no_more(spark, monkeypatch):
    """Blocks grow in number with the images; what is shuffled and stored grows with the images, not with blocks times images."""
    bits, known = near_descriptors(np.random.default_rng(6))
    rows = [(i, 7 * i, bits[i].tobytes(), int(known[i])) for i in range(len(bits))]
    df = spark.createDataFrame(rows, "image_id long, place long, bits binary, known long").repartition(3)
    monkeypatch.setattr(media, "TINY_ROWS", 1)
    context, gateway = spark.sparkContext._jsc.sc(), spark.sparkContext._gateway

    def written_to_shuffles():
        context.listenerBus().waitUntilEmpty()
        stages = context.statusStore().stageList(None, False, False, gateway.new_array(gateway.jvm.double, 0), gateway.jvm.java.util.ArrayList())
        return {(x.stageId(), x.attemptId()): x.shuffleWriteBytes() for x in map(stages.apply, range(stages.size()))}

    sent, found = [], []
    for blocks in (2, 8):
        monkeypatch.setattr(media, "BLOCKS", blocks)
        before = written_to_shuffles()
        found.append(sorted(map(tuple, media.matches(df).collect())))
        sent.append(sum(n for stage, n in written_to_shuffles().items() if stage not in before))
    assert found[0] == found[1] and len(found[0]) > 20_000
    assert sent[1] < 1.7 * sent[0], sent


def images_with_a_logo(n):
    """Images that share many single corners, each with a copy."""
    rng = np.random.default_rng(8)
    logo = np.kron(rng.integers(0, 256, (9, 9)), np.ones((4, 4)))
    out = {}
    for i in range(n):
        out[2 * i] = np.kron(rng.integers(0, 256, (24, 24)), np.ones((4, 4)))
        out[2 * i][:36, :36] = logo
        out[2 * i + 1] = out[2 * i][2:, 3:] * 0.8 + 20
    return out


def test_matches_of_unrelated_images_are_not_written(spark, monkeypatch):
    """They grow with the square of the images: no table has more rows than there are descriptors."""
    sizes = {}

    def counted(df, name):
        out = written(df, name)
        sizes[name] = out.count() + sizes.get(name, 0)
        return out

    written = media.written
    monkeypatch.setattr(media, "written", counted)
    rows = [(i, media.encode_pgm(x)) for i, x in images_with_a_logo(300).items()]
    out = dict(media.copy_classes(spark.createDataFrame(rows, "image_id long, media binary")).select("image_id", "class_id").collect())
    assert sum(out[i + 1] == i for i in range(0, 600, 2)) > 260 and all(out[i] == i for i in range(0, 600, 2))
    assert all(n <= sizes["media-descriptors"] for n in sizes.values()), sizes


@pytest.mark.parametrize("held_matches", [100, 10**9])
def test_links_of_blocks_are_those_of_all_pairs(held_matches):
    """Also where blocks are halved, since they have more matches than are held."""
    described = [(i, place, bits) for i, x in images_with_a_logo(40).items() for place, bits in zip(*(lambda y, x, s, t, b: (media._placed(y, x, s, t), b))(*media.describe(x[None])[1:]), strict=True)]
    image, place = (np.array([r[k] for r in described]) for k in (0, 1))
    words = np.stack([r[2] for r in described]).view(">u8").astype(np.uint64)
    block = [tuple(x[image // 2 % 2 == k] for x in (image, place, words, image)) for k in (0, 1)]
    pairs = [(block[0], None), (block[1], None), (block[0], block[1])]
    found = [(int(a), int(b)) for one, two in pairs for links in media._linked(one, two, 5, held_matches) for a, b in zip(*links, strict=True)]
    expected = set()
    for a, b in itertools.combinations(range(80), 2):
        i, j = np.flatnonzero(image == a), np.flatnonzero(image == b)
        k, m = np.nonzero(np.bitwise_count(words[i][:, None] ^ words[j][None]).sum(axis=2) <= 16)
        if len(k) >= 5 and media.agreeing(*np.unique(np.column_stack([place[i][k], place[j][m]]), axis=0).T):
            expected.add((a, b))
    assert len(expected) >= 36 and len(found) == len(set(found)) and set(found) == expected


def test_agreement_is_found_among_very_many_matches():
    """Six corners agree on a shift, among 4000 matches that agree on nothing: each match is tried."""
    rng = np.random.default_rng(6)
    at = lambda n: media._placed(rng.uniform(0, 4000, n), rng.uniform(0, 4000, n), np.full(n, 3), rng.integers(0, 64, n))
    few = rng.permutation(4000)
    y, x = np.array([100, 160, 230, 310, 400, 450.0]), np.array([90, 300, 130, 410, 220, 350.0])
    same = [media._placed(y + d, x + 2 * d, np.full(6, 3), np.full(6, 5)) for d in (0, 40)]
    # The other matches repeat two corners of each image, so that they are few corners.
    noise = at(40)[few % 8], at(40)[few % 5]
    pa_, pb = (np.concatenate(x) for x in zip(same, noise, strict=True))
    assert media.agreeing(pa_, pb) >= 6 and media.agreeing(*noise) == 0


def test_formats_sizes_and_columns(spark):
    rng = np.random.default_rng(2)
    large = rng.integers(0, 256, (20, 44)).repeat(30, 0).repeat(30, 1)
    rows = [(1, media.encode_pgm(large)), (2, media.encode_pgm(large * 0.9)), (3, media.encode_pgm(rng.integers(0, 256, (20, 20)))), (4, b"\xff\xd8\xff\xe0 jpeg"), (5, media.encode_pgm(np.zeros((1, 1)))), (6, media.encode_pgm(np.zeros((1, 3000)))), (7, png(rng.integers(0, 256, (50, 60)).astype(np.uint8)))]
    out = {r.image_id: (r.class_id, r.readable) for r in media.copy_classes(spark.createDataFrame(rows, "image_id long, media binary")).collect()}
    assert out == {1: (1, True), 2: (1, True), 3: (3, True), 4: (4, False), 5: (5, True), 6: (6, True), 7: (7, True)}


# ------------------------------------------------------------------ pipeline


def overlap_classes(rows):
    """The class of each (id, text) by brute force over all pairs."""
    sets = [set(zip(*(t.lower().split()[k:] for k in range(5)), strict=False)) or {tuple(t.lower().split())} for _, t in rows]
    label = [i for i, _ in rows]
    for x, y in itertools.combinations(range(len(rows)), 2):
        if label[x] != label[y] and len(sets[x] & sets[y]) >= 0.8 * len(sets[x] | sets[y]):
            low, high = sorted((label[x], label[y]))
            label = [low if k == high else k for k in label]
    return set(label)


def test_pipeline_keeps_clean_documents_and_drops_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    current, ids = docs, {}
    for name, stage in corpus_pipeline.STAGES:
        from linespark.llm.common import written

        current = written(stage(spark, current, SF), "test")
        ids[name] = {r[0] for r in current.select("doc_id").collect()}
        if name != "sentencepiece":
            assert current.columns == docs.columns
    assert ids["language"] == {r[0] for r in docs.select("doc_id").collect()}
    # The stage's rule is an overlap of five-word shingles of 0.8 or more, not that of op2_simhash.
    assert ids["near_duplicates"] == overlap_classes([(r.doc_id, r.text) for r in docs.collect()])
    assert len(ids["mixing"]) > 0.8 * len(ids["substrings"])
    assert all(r.parity for r in current.collect())


ODD_DOCS = "doc_id long, text string, lang string, source string, n_chars int, " + ", ".join(f"{c} string" for c in ("key", "row", "version", "first_id", "nth", "component", "rate", "spans", "parity", "marks"))


@pytest.mark.parametrize("only", ["null id beside others", "null id alone"])
def test_pipeline_stages_on_odd_rows(spark, tmp_path, only):
    from linespark.llm.common import written

    rng = random.Random(4)
    say = lambda n: " ".join(rng.choices([f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(500)], k=n))
    one, other, long = say(60), say(60), say(60_000)
    rows = [(1, one), (1, one), (None, one), (2, other), (2, say(60)), (3, None), (4, ""), (5, " 12 !"), (6, long), (7, long)]
    rows += [(None, say(50))] * 2 if only == "null id beside others" else []
    rows = [(i, t, None if k % 3 else "en", None, len(t or ""), *["own"] * 10) for k, (i, t) in enumerate(rows)]
    for table in ("documents", "labels"):
        schema = ODD_DOCS if table == "documents" else "doc_id long, quality int, toxic int"
        spark.createDataFrame(rows if table == "documents" else [(1, 1, 0), (None, 0, 1), (2, None, None)], schema).write.parquet(str(tmp_path / f"{table}.parquet"))
    docs, kept = spark.read.parquet(str(tmp_path / "documents.parquet")), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), "test")
        kept[name] = sorted((str(r.doc_id), len((r.text or "").split())) for r in docs.collect()) if name != "sentencepiece" else docs.count()
        assert name == "sentencepiece" or {r.parity + r.row + r.key for r in docs.collect()} == {"ownownown"}
    extra = [("None", 50)] * (only == "null id beside others")
    assert kept["language"] == sorted([("1", 60)] * 2 + [("None", 60), ("2", 60), ("2", 60), ("6", 60_000), ("7", 60_000)] + extra * 2)
    assert kept["near_duplicates"] == kept["substrings"] == sorted([("1", 60), ("2", 60), ("2", 60), ("6", 60_000)] + extra)
    assert set(kept["mixing"]) <= set(kept["substrings"]) and kept["sentencepiece"] == len(kept["mixing"]) > 0


def test_pipeline_on_an_empty_table_leaves_no_tables_behind(spark, tmp_path, monkeypatch):
    spark.createDataFrame([], ODD_DOCS).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    monkeypatch.setattr(shared, "shared_dir", lambda spark: f"file://{tmp_path}/shared")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [p.name.split("-")[1] for p in (tmp_path / "shared").iterdir()] == ["mixing"]


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_registered_queries_equal_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("pages", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    ours = queries.queries()[name](spark, SF)
    names = ours.columns
    theirs = con.execute(f"select {', '.join(names)} from ({queries.oracle_sql()[name]})").fetchall()
    assert sorted(map(repr, (tuple(r) for r in ours.collect()))) == sorted(map(repr, theirs))
