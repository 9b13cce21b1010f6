"""Operators on single texts: rules, languages, URLs, pages, tokens."""

import base64
import hashlib
import itertools
import math
import random
import time
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystone.llm import bpe, divergence, html_crf, language_id, token_counts, url_rules
from tallystone.llm.common import WORD
from tallystone.llm.labelled_pages import page as labelled_page
from tallystone.llm.page_blocks import blocks

ODD = [None, "", " ", "\n\n", "a", "é", "🙂🙃 x", "x" * 3000, "word " * 5000, "tab\tand\x0bvt\x1cfs\x85nel\u2028ls", "don't we'll I'VE", "<|endoftext|> <|x|>", "  two  spaces   three\n\n\n lines \n", "a\u0301 ß ǅ ٣ Ⅷ ½ 漢字かな 한국어", "\x00\x01\x7f", "\ufeffbom \u200bzero", "1234567 12a 3.14", "...!!! --- ###"]


def rows(texts, lang="en"):
    return [(i, t, lang, "s", "x", 1) for i, t in enumerate(texts)]


SCHEMA = "doc_id long, text string, lang string, source string, n_words string, kept int"


def brute_base(text):
    text = text or ""
    words = WORD.findall(text)
    seen, dups = [], 0
    for line in text.split("\n"):
        if WORD.search(line):
            dups += line in seen
            seen.append(line)
    windows = [tuple(words[i : i + 8]) for i in range(len(words) - 7)]
    inside = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(8)}
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), dups, len(inside)


def test_base_counts_match_brute_force():
    rng = random.Random(1)
    texts = [t for t in ODD if t is None or len(t) < 5000]
    texts += ["\n".join(" ".join(rng.choice("ab#") for _ in range(rng.randint(0, 6))) for _ in range(rng.randint(0, 40))) for _ in range(60)]
    for t in texts:
        assert divergence.base(t)[1] == brute_base(t), t


def prose(rng, common, rare, n):
    return " ".join(rng.choice(common) if rng.random() < 0.4 else rng.choice(rare) for _ in range(n)).capitalize() + "."


def test_divergence(spark):
    rng = random.Random(2)
    common, rare = "the of and to in a is that for it as was".split(), ["".join(rng.choices("abcdefghilmnoprstu", k=6)) for _ in range(400)]
    clean = [prose(rng, common, rare, 200) for _ in range(60)]
    shouted = [t.upper().replace(" ", "!! ") for t in clean[:5]]
    lists = [" | ".join(rng.choices(rare, k=200)) for _ in range(5)] + [" ".join(rng.choices(rare, k=n)) for n in (60, 80, 100, 150)]
    texts = clean + shouted + lists + ODD + [clean[0], clean[0]]
    docs = spark.createDataFrame(rows(texts) + [(None, clean[1], None, None, None, None)], SCHEMA)
    found = divergence.judge(docs).collect()
    assert len(found) == len(texts) + 1 and all(r.kept for r in found if r.doc_id is None)
    got = {r.doc_id: r for r in found}
    assert all(got[i].kept for i in range(60))
    assert not any(got[i].kept for i in range(60, 74))
    assert got[len(texts) - 1].kept and got[len(texts) - 2].kept
    for i, t in enumerate(texts):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == divergence.base(t)[1]
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)
    kept = divergence.good(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.where("doc_id is not null").collect()) == sorted(i for i, r in got.items() if i is not None and r.kept)
    assert divergence.judge(docs.limit(0)).count() == 0 and divergence.good(docs.limit(0)).count() == 0


def test_every_language_has_its_reference(spark):
    rng = random.Random(12)
    own = {"it": ("di che la il un per non sono del con".split(), "abcdefgilmnopruvz"), "pl": ("w na się z do nie jest że i przez".split(), "abcdeghijklmnoprstwyząęłó"), "zh": ("的 是 在 了 有 和 不 我 这 人".split(), "天地山水大小中上下年月日国家时间工作学生".strip())}
    texts, langs = [], []
    for lang, (common, letters) in own.items():
        rare = ["".join(rng.choices(letters, k=rng.randint(2, 6))) for _ in range(300)]
        texts += [prose(rng, common, rare, n) for n in (60, 150, 400) for _ in range(12)]
        langs += [lang] * 36
    # a language with too few documents for a reference is not judged
    texts += ["".join(rng.choices("αβγδεζηθικλμ ", k=600)) for _ in range(3)]
    langs += ["el"] * 3
    # a text that is like none of the known languages
    texts += [" ".join("".join(rng.choices("0123456789#", k=5)) for _ in range(100))]
    langs += ["it"]
    docs = spark.createDataFrame([(i, t, k, "s", "x", 1) for i, (t, k) in enumerate(zip(texts, langs, strict=True))], SCHEMA)
    got = {r.doc_id: r.kept for r in divergence.judge(docs).collect()}
    assert [i for i in got if not got[i]] == [len(texts) - 1]


def test_common_words_are_counted_by_document(spark, monkeypatch):
    monkeypatch.setattr(divergence, "COUNTED", 50)
    rng = random.Random(13)
    texts = [" ".join(rng.choices([f"W{i}," for i in range(40)], k=rng.randint(15, 60))) for _ in range(30)] + ["again " * 500]
    counts = {}
    for t in texts:
        if len(t.split()) >= 20:
            for w in {w.strip(",").lower() for w in t.split()}:
                counts[w] = counts.get(w, 0) + 1
    want = sorted(counts, key=lambda w: (-counts[w], w))[:32]
    assert divergence.common_words(spark.createDataFrame(rows(texts), SCHEMA)) == {"en": want} and "again" not in want[:5]


def test_base_counts_of_texts_beyond_one_chunk():
    text = "Über ಕನ್ನಡ 123, und #so weiter " * 60_000
    chars = divergence.class_counts(text)
    assert chars.sum() == len(text) > 1 << 20
    one = divergence.class_counts(text[:len(text) // 60_000])
    assert (chars == one * 60_000).all()
    assert divergence.classes()[0x30000] == 2


def test_divergence_bounds():
    assert divergence.divergence(np.array([[1, 0]]), np.array([0, 3])).tolist() == [1.0]
    assert divergence.divergence(np.array([[2, 2]]), np.array([5, 5])).tolist() == [0.0]


def test_language_held_out_accuracy(spark):
    rng = random.Random(3)
    own = {"de": "schung keit ver ein über heit für", "en": "the ing tion that wh ly ed", "fr": "eau tion que é è oi eux", "es": "ción ñ os as que mente el"}
    texts = [(lang, " ".join("".join(rng.choices(parts.split(), k=2)) for _ in range(30))) for lang, parts in own.items() for _ in range(60)]
    data = [(i, t, k, "s", "x", 1) for i, (k, t) in enumerate(texts)]
    data += [(1000 + i, t, "en", "s", "x", 1) for i, t in enumerate([None, "", "123 !!", "\u0301"])] + [(None, "the that", None, None, None, None), (7, data[7][1], "de", "s", "x", 1)]
    docs = spark.createDataFrame(data, SCHEMA)
    got = language_id.identify(docs).collect()
    assert len(got) == len(data)
    assert {r.doc_id: r.held_out for r in got if r.doc_id is not None} == {d[0]: zlib.crc32(str(d[0]).encode()) % 3 == 1 for d in data if d[0] is not None}
    held = [r for r in got if r.held_out and r.doc_id < 1000]
    assert sum(r.lang_pred == texts[r.doc_id][0] for r in held) >= 0.98 * len(held) > 30
    assert all(r.lang_pred == "und" and r.score == 0 for r in got if r.doc_id in (1000, 1001, 1002, 1003))
    assert all(0 <= r.score <= 1 for r in got)
    kept = language_id.confident(docs)
    assert kept.columns == docs.columns and kept.count() == len(data) - 4
    empty = language_id.identify(docs.where("lang is null")).first()
    assert empty.lang_pred == "und" and not empty.held_out
    assert language_id.identify(docs.limit(0)).count() == 0 and language_id.confident(docs.limit(0)).count() == 0
    clash = docs.withColumn("held_out", F.lit("x")).withColumn("lang_pred", F.lit("x")).withColumn("score", F.lit("x"))
    assert sorted(map(repr, language_id.identify(clash).collect())) == sorted(map(repr, got))


def plain_grams(text, bits):
    """Buckets of the n-grams of one text, one by one."""
    mask, mix = (1 << 64) - 1, int(language_id.MIX)
    own = [c if c.isalpha() else " " for c in f" {text.lower()} "]
    for n in (1, 2, 3):
        for i in range(len(own) - n + 1):
            gram = own[i : i + n]
            if gram == [" "] or any(a == b == " " for a, b in zip(gram, gram[1:], strict=False)):
                continue
            h = ord(gram[0]) + 1
            for c in gram[1:]:
                h = h * mix + ord(c) + 1 & mask
            yield ((h if n == 1 else h ^ h >> 29) * mix & mask) >> 64 - bits


def test_scores_are_those_of_a_plain_bayes(spark):
    rng = random.Random(21)
    own = {"a": "abcdeé", "b": "defgh ", "c": "xyzİß "}
    data = [(i, "".join(rng.choices(own[k] + " .", k=rng.randint(0, 80))), k) for i, k in enumerate(rng.choices(list(own), k=90))]
    docs = spark.createDataFrame(data, "doc_id long, text string, lang string")
    model = language_id.train(docs)
    counts = {k: Counter() for k in own}
    for i, t, k in data:
        if zlib.crc32(str(i).encode()) % 3 != 1:
            counts[k].update(plain_grams(t, model.bits))
    size = 1 << model.bits
    for r in language_id.identify(docs, model).collect():
        grams = Counter(plain_grams(data[r.doc_id][1], model.bits))
        sums = {k: sum(n * math.log((counts[k][g] + 0.5) / (counts[k].total() + 0.5 * size)) for g, n in grams.items()) for k in own}
        if not grams:
            assert (r.lang_pred, r.score) == ("und", 0.0)
            continue
        best = max(sums, key=sums.get)
        assert r.score == pytest.approx(1 / sum(math.exp(v - sums[best]) for v in sums.values()), abs=1e-9)
        assert sums[r.lang_pred] == pytest.approx(sums[best])


def test_equal_languages_go_to_the_first(spark):
    docs = spark.createDataFrame([(i, "same text here", k) for i, k in enumerate("bbbbaaaabbaa")], "doc_id long, text string, lang string")
    model = language_id.Model(["a", "b"], np.zeros((1 << 10, 2)), 10)
    assert {(r.lang_pred, r.score) for r in language_id.identify(docs, model).collect()} == {("a", 0.5)}


def test_texts_of_no_learned_language_are_not_confident(spark):
    train = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    rng = random.Random(5)
    strange = ["Сегодня утром мы пошли в магазин за хлебом и молоком, потому что дома ничего не было. " * 3, "Dzisiaj rano poszliśmy do sklepu po chleb i mleko, ponieważ w domu niczego już nie było, a dzieci czekały. " * 3]
    strange += [base64.b64encode(rng.randbytes(300)).decode(), " ".join("".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=7)) for _ in range(60))]
    docs = train.unionByName(spark.createDataFrame([(-1 - i, t, None) for i, t in enumerate(strange)], "doc_id long, text string, lang string"))
    kept = {r.doc_id for r in language_id.confident(docs).select("doc_id").collect()}
    assert min(kept) >= 0
    clean = spark.read.parquet("/root/testdata/sf0.01/labels.parquet").where("quality = 1").join(train, "doc_id").where("text is not null")
    assert {r.doc_id for r in clean.select("doc_id").collect()} <= kept


@pytest.mark.parametrize("text", ["Die Straße führt über den Fluß. " * 40, "İstanbul'da İKİ IŞIK yandı, İzmir'de DEĞİL. " * 40])
def test_long_texts_are_counted_in_chunks(monkeypatch, text):
    want = np.bincount(list(plain_grams(text, 12)), minlength=1 << 12)
    for chunk in (1 << 17, 37):
        monkeypatch.setattr(language_id, "CHUNK", chunk)
        assert (language_id.bucket_counts(text, 12) == want).all()
        model = language_id.Model(["x"], np.random.default_rng(0).random((1 << 12, 1)), 12)
        sums, n = model.scores(["", text, None, text[:50], "..."])
        assert n.tolist() == [0, want.sum(), 0, sum(1 for _ in plain_grams(text[:50], 12)), 0]
        assert sums[1, 0] == pytest.approx(float(want @ model.log_p[:, 0]))


def brute_rule(host, path, rules, default="allow"):
    fits = [r for r in rules if (host == r[0] or host.endswith("." + r[0])) and path.startswith(r[1])]
    best = max(fits, key=lambda r: (len(r[0]) + len(r[1]), len(r[0]), r[2] == "block"), default=None)
    return (best[0] + best[1], best[2]) if best else (None, default)


def test_url_rules_match_brute_force(spark):
    rng = random.Random(4)
    names = ["com", "net", "a", "b", "ab", "www"]
    hosts = [".".join(rng.choices(names, k=rng.randint(1, 4))) for _ in range(25)]
    rules = sorted({(rng.choice(hosts), "/" + "/".join(rng.choices("xy", k=rng.randint(0, 2))), rng.choice(["block", "allow"])) for _ in range(60)})
    urls = [f"http://{rng.choice(hosts + ['q.' + h for h in hosts]).upper()}/{'/'.join(rng.choices('xyz', k=rng.randint(0, 3)))}{rng.choice(['', '?a=/b', '#c'])}" for _ in range(300)]
    urls += [None, "", "nothing", "http://", "http:///x", "x://a.com", "HTTP://Ä.COM?q", "ftp://a:80/x/y", "http://a.com\n/x"] + ["http://www.a.com/x/y"] * 300
    pages = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)] + [(None, "http://a.com/x", "c")], "page_id long, url string, host string")
    got = url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), ranges=7).collect()
    assert len(got) == len(urls) + 1
    for r in got:
        if r.page_id is None:
            continue
        rest = urls[r.page_id].split("://", 1)[1] if urls[r.page_id] and "://" in urls[r.page_id] else None
        cut = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)]) if rest is not None else 0
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:cut]) if rest is not None else ""
        path = rest[cut:].split("?")[0].split("#")[0] if rest is not None else ""
        assert (r.host, r.path) == (host, path), urls[r.page_id]
        assert (r.rule, r.verdict) == (brute_rule(host, path, rules) if host else (None, "allow")), urls[r.page_id]
    none = url_rules.judge(pages, spark.createDataFrame([], "host string, path string, verdict string"))
    assert {r.verdict for r in none.collect()} == {"allow"}
    assert url_rules.judge(pages.limit(0), spark.createDataFrame(rules, "host string, path string, verdict string")).count() == 0


def test_one_host_with_many_rules(spark):
    rules = [("a.com", f"/{i}/{i * 7}", "block" if i % 2 else "allow") for i in range(4000)] + [("com", "/", "allow"), ("a.com", "", "block"), ("a.com", "/1/7", "allow"), ("b.com", None, "allow")]
    urls = [f"http://{h}a.com/{i}/{i * 7}{t}" for i in range(0, 4000, 40) for h in ("", "w.") for t in ("", "/x?q")] + ["http://a.com/none", "http://a.com/" + "x" * 300_000, "http://b.com/" + "y" * 300_000]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    usable = [r for r in rules if r[1] is not None]
    for r in url_rules.judge(pages, spark.createDataFrame(rules, "host string, path string, verdict string"), ranges=5).collect():
        assert (r.rule, r.verdict) == brute_rule(r.host, r.path, usable), urls[r.page_id][:60]


def test_labels_of_held_out_pages():
    field, wrong, total = html_crf.default_field(), 0, 0
    for seed in range(7000, 7150):
        page, labels = labelled_page(seed)
        found, best = field.labels(page)
        assert len(found) == len(labels)
        wrong += sum(a != b for a, b in zip(best, labels, strict=True))
        total += len(labels)
    assert wrong <= 0.01 * total


P1 = "The harbour was quiet that morning, and the boats lay still beside the long stone wall."
P2 = "Nobody had seen the keeper since the storm, although his lamp was burning every night."
P3 = "In the village they told each other that he had left, but they did not believe it."
WRITTEN = {
 "table layout": (f"<html><body><table width=100%><tr><td colspan=2><h2>My Site</h2></td></tr><tr><td class=nav><a href=/>Home</a><br><a href=/a>About</a><br><a href=/l>Links</a></td><td><h1>The keeper</h1><p>{P1}<p>{P2}<p>{P3}</td></tr><tr><td colspan=2><small>Copyright 1998 My Site</small></td></tr></table>", ["The keeper", P1, P2, P3]),
 "definition list": (f"<body><header><a href=/>Words</a></header><nav><a href=/a>A</a> <a href=/b>B</a></nav><main><h1>Terms of the sea</h1><dl><dt>Harbour</dt><dd>{P1}</dd><dt>Keeper</dt><dd>{P2}</dd></dl></main><footer>© Words</footer>", ["Terms of the sea", "Harbour", P1, "Keeper", P2]),
 "aside within": (f"<body><article><h1>The keeper</h1><p>{P1}</p><aside><h4>Related</h4><ul><li><a href=/x>Other lights</a></li></ul></aside><p>{P2}</p><figure><img src=x><figcaption>The lamp at night.</figcaption></figure><p>{P3}</p></article>", ["The keeper", P1, P2, "The lamp at night.", P3]),
 "plain divs": (f"<body><div id=top><div>Log in</div><div>Search</div></div><div id=page><div><h1>The keeper</h1></div><div>{P1}</div><div>{P2}</div><div>{P3}</div></div><div id=bottom><div>Terms</div><div>Privacy</div></div>", ["The keeper", P1, P2, P3]),
 "comments": (f"<body><nav><ul><li><a href=/>Home</a></ul></nav><div class=post><h1>The keeper</h1><p>{P1}</p><p>{P2}</p><pre>lamp = on\nwall = long</pre></div><div id=comments><h2>2 responses</h2><ol><li><p>Ann wrote: {P3}</p></li><li><p>{P2}</p></li></ol><form><label>Name</label><input><button>Send</button></form></div>", ["The keeper", P1, P2, "lamp = on wall = long"]),
 "nested articles": (f"<body><main><article><h1>The keeper</h1><p>{P1}</p><section><h2>Later</h2><p>{P2}</p><ul><li>{P3}</li><li>Short one.</li></ul></section></article></main><aside><article><h3>Read next</h3><p>Ten more stories.</p></article></aside>", ["The keeper", P1, "Later", P2, P3, "Short one."]),
 "table data": (f"<body><main class=entry-content><h1>Lights</h1><p>{P1}</p><table><caption>Heights</caption><tr><th>Name<th>Metres<tr><td>North<td>31<tr><td>South<td>12</table><p>{P2}</p></main><div class=widget><h3>Tags</h3><a href=/t>sea</a> <a href=/u>lamp</a></div>", ["Lights", P1, "Heights", "Name", "Metres", "North", "31", "South", "12", P2]),
}


@pytest.mark.parametrize("kind", list(WRITTEN))
def test_pages_of_another_writer(kind):
    """Pages written by hand, in ways of their own."""
    page, want = WRITTEN[kind]
    assert html_crf.default_field().text(page).split("\n") == want


def test_training_follows_the_gradient_of_the_likelihood():
    """The field's likelihood on its training pages, summed over all chains, is at its top."""
    pages = [labelled_page(seed) for seed in range(400) if 0 < len(labelled_page(seed)[1]) <= 9][:12]
    field = html_crf.train(pages)

    def likelihood(change):
        total = 0.0
        for page, labels in pages:
            e = field.score(blocks(page))
            score = {y: field.start[y[0]] + sum((v + field.bias) * k for v, k in zip(e, y, strict=True)) + sum(change[a][b] for a, b in itertools.pairwise(y)) for y in itertools.product((0, 1), repeat=len(labels))}
            top = max(score.values())
            total += score[tuple(labels)] - top - math.log(sum(math.exp(v - top) for v in score.values()))
        return total - html_crf.PENALTY / 2 * sum(v * v for row in change for v in row)

    best = likelihood(field.change)
    for a in (0, 1):
        for b in (0, 1):
            for step in (-1.0, 1.0):
                moved = [list(row) for row in field.change]
                moved[a][b] += step
                assert likelihood(moved) < best


def test_labels_that_do_not_fit_are_an_error():
    with pytest.raises(ValueError, match="labels"):
        html_crf.train([("<p>one</p><p>two</p>", [1])])


@pytest.mark.parametrize("part", ['<a "', "<a '\"", "<p 'x>' ", "<!--", "<script>", "<script></script ", "</a", "<", "<svg a=\"'", "<div><p "])
def test_broken_pages_take_time_in_proportion(part):
    began = time.perf_counter()
    blocks(part * (400_000 // len(part)))
    assert time.perf_counter() - began < 4


def test_viterbi_is_the_best_chain():
    field = html_crf.default_field()
    for seed in range(40):
        page, labels = labelled_page(seed)
        if len(labels) > 10:
            continue
        found, best = field.labels(page)
        scores = field.score(found)

        def total(y, scores=scores):
            s = field.start[y[0]] + sum((e + field.bias) * v for e, v in zip(scores, y, strict=True))
            return s + sum(field.change[a][b] for a, b in zip(y, y[1:], strict=False))

        chains = [[n >> i & 1 for i in range(len(found))] for n in range(2 ** len(found))]
        assert total(best) == pytest.approx(max(map(total, chains)))


def test_main_text(spark):
    body = "<p>Long prose stands here, with words and more words, and it goes on for a while.</p>" * 3
    pages = [
        f"<html><body><nav><ul><li><a href=/x>Home</a></ul></nav><article><h1>Title &amp; more</h1>{body}<p>caf&eacute;  a\n b<br>c &lt;x&gt;</article><footer>&copy; me</footer>",
        f'<body><div class="cookie-banner">We use cookies.</div><main><div class="post">{body}<script>if (a < b) "</p>"</script></div></main><section id="comments"><h3>2 comments</h3><div class="comment"><p>I think so too, and I write a lot about it here.</p></div></section>',
        None, "", "   ", "<", "<p", "<!-- never closed", "plain words only", '<p title="unclosed>x</p>', "<nav>" * 2000 + "x",
    ]
    data = [(i, f"u{i}", p, "clash") for i, p in enumerate(pages)] + [(0, None, pages[0], "c")]
    got = html_crf.main_text(spark.createDataFrame(data, "page_id long, url string, html string, text string")).collect()
    assert len(got) == len(data) and all(len(r.text) == r.n_chars for r in got)
    prose = "Long prose stands here, with words and more words, and it goes on for a while."
    text = {r.page_id: r.text for r in got}
    assert text[0] == "\n".join(["Title & more", prose, prose, prose, "café a b c <x>"])
    assert text[1] == "\n".join([prose] * 3)
    assert text[2] == text[3] == text[4] == text[7] == ""
    assert html_crf.main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_blocks_of_broken_markup():
    found = blocks("<ul><li>one<li>two</ul><p><b>three<p>four</b> five</div><table><tr><td>a<td>b</table><SCRIPT>x</Script >six")
    assert [(b.text, b.tag) for b in found] == [("one", "li"), ("two", "li"), ("three", "p"), ("four five", "p"), ("a", "td"), ("b", "td"), ("six", "body")]


def test_formulas_and_fallbacks_are_text():
    found = blocks("<p>So <math><mrow><mi>a</mi><mo>+</mo><mn>1</mn></mrow></math> holds, <object data=x>a <b>drawing</b></object> shows, <video src=v>a film</video> too.</p><canvas><p>bars</p></canvas>")
    assert [(b.text, b.tag) for b in found] == [("So a+1 holds, a drawing shows, a film too.", "p"), ("bars", "p")]
    assert [(b.text, b.tag) for b in blocks("<p>one <object><p>two</p></object> three</p>")] == [("one", "p"), ("two", "p"), ("three", "p")]


@pytest.mark.parametrize("tag", ["div", "span"])
def test_deep_blocks_keep_their_ancestors(tag):
    found = blocks("<body>" + f"<{tag}>" * 300 + "<nav>" + f"<{tag}>" * 40_000 + "<p>deep</p>" + f"</{tag}>" * 40_000 + "<p>in</p></nav><p>out</p>")
    assert [(b.text, "in:nav" in b.features) for b in found] == [("deep", True), ("in", True), ("out", False)]


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers as P
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def fuzz(n):
    rng = random.Random(9)
    pool = [chr(c) for c in (*range(0, 0x180), 0x1680, *range(0x2000, 0x2030), 0x3000, 0x4E2D, 0x1F642, 0x0301, 0x0663, 0x2167, 0xFEFF)] + ["'s", "'LL", "  ", "\n\n", " the", "ing"]
    return ["".join(rng.choices(pool, k=rng.randint(1, 60))) for _ in range(n)]


def planes(n):
    """Texts of all planes, with the newest letters and numbers of each."""
    rng = random.Random(19)
    new = [0x558, 0x88F, 0xC5C, 0x11DE0, 0x11DE5, 0x16EA0, 0x323B0, 0x33479, 0x10EC2, 0xA7CE]
    return ["".join(chr(rng.choice([rng.randrange(0x20, 0xD800), rng.randrange(0xE000, 0x110000), rng.choice(new), 0x20, 0x61])) for _ in range(rng.randint(1, 30))) for _ in range(n)]


def test_bpe_equals_reference(spark, reference):
    texts = ODD + fuzz(1500) + planes(1500) + ["unlike " + " ".join(f"p{i}q" for i in range(3000))]
    docs = spark.createDataFrame(rows(texts), SCHEMA)
    got = {r.doc_id: r for r in bpe.digests(docs).collect()}
    for i, t in enumerate(texts):
        ids = np.array(reference.encode_ordinary(t or ""), dtype="<u4").tobytes()
        assert got[i].ids_sha256 == hashlib.sha256(ids).hexdigest(), repr(t)
        assert got[i].n_tokens == len(ids) // 4 and got[i].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    assert bpe.digests(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b", 1), (3, "a b", 2), (3, "a b", 2)], "doc_id long, text string, n_tokens long")
    again = bpe.digests(odd).collect()
    assert len({r[1:] for r in again}) == 1 and sorted(str(r.doc_id) for r in again) == ["3", "3", "None"]


def test_long_texts_go_part_by_part(monkeypatch, reference):
    text = " ".join(f"w{i} 漢字{i}\n" for i in range(3000))
    want = np.array(reference.encode_ordinary(text), dtype="<u4").tobytes()
    for name, value in (("LONG_TEXT", 50), ("PIECES", 7), ("SLICE", 11), ("KEPT_PIECES", 100)):
        monkeypatch.setattr(bpe, name, value)
    own = bpe.Codec(bpe.vocabulary_path())
    parts = list(own.parts(text))
    assert len(parts) > 100 and b"".join(parts) == want and own.decode(want) == text.encode()


def test_kept_pieces_are_bounded(monkeypatch):
    monkeypatch.setattr(bpe, "KEPT_PIECES", 5)
    own = bpe.Codec(bpe.vocabulary_path())
    fresh = bpe.Codec(bpe.vocabulary_path())
    for t in fuzz(50):
        ids = own.encode(t)
        fresh.kept = {}
        assert ids == fresh.encode(t) and own.decode_text(ids) == t
        assert len(own.kept) <= 100


def test_decoding_in_parts_and_offsets():
    own = bpe.codec(bpe.vocabulary_path())
    for t in [*fuzz(60), "🙂é漢"]:
        ids = own.encode(t)
        decoder = bpe.Decoder(own)
        parts = [decoder.feed(ids[i : i + 4]) for i in range(0, len(ids), 4)] + [decoder.feed(b"", last=True)]
        assert "".join(parts) == t
        first, end = own.char_spans(t, ids)
        raw = t.encode()
        at = own.byte_spans(ids)
        for k in range(len(first)):
            a, b = at[k], at[k + 1]
            assert first[k] == len(raw[:a].decode(errors="ignore")) and end[k] == len(raw[: b].decode(errors="replace")) - (0), (t, k)


@pytest.mark.parametrize("rule", ["start", "end", "most"])
def test_attribution_matches_brute_force(rule):
    rng = random.Random(6)
    own = bpe.codec(bpe.vocabulary_path())
    for t in fuzz(80) + ["one two\nthree four\n\nfive"]:
        cuts = sorted(rng.sample(range(len(t) + 1), min(len(t) + 1, 5)))
        spans = [(a, b) for a, b in zip(cuts, cuts[1:], strict=False) if b > a][:: rng.choice([1, 2])]
        if not spans:
            continue
        first, end = own.char_spans(t, own.encode(t))
        counts, _ = token_counts.attribute(first, end, spans, rule)
        want = [0] * len(spans)
        for a, b in zip(first.tolist(), end.tolist(), strict=True):
            b = max(b, a + 1)
            cover = [sum(x <= c < y for c in range(a, b)) for x, y in spans]
            if rule == "most":
                best = max(range(len(spans)), key=lambda i: (cover[i], -i))
                if cover[best]:
                    want[best] += 1
            else:
                c = a if rule == "start" else b - 1
                for i, (x, y) in enumerate(spans):
                    want[i] += x <= c < y
        assert counts.tolist() == want, (t, spans, rule)


def test_section_tokens(spark, reference):
    docs = spark.createDataFrame(rows(ODD), SCHEMA)
    got = token_counts.section_tokens(docs).collect()
    for i, t in enumerate(ODD):
        own = sorted((r for r in got if r.doc_id == i), key=lambda r: r.section)
        assert sum(r.n_tokens for r in own) == len(reference.encode_ordinary(t or ""))
        assert sum(r.n_chars for r in own) == len(t or "")
        assert all(r.doc_tokens == sum(x.n_tokens for x in own) for r in own)
    assert token_counts.section_tokens(docs.limit(0)).count() == 0
    odd = spark.createDataFrame([(None, "a b\nc", "x", 1), (4, "a b\nc", "x", 1), (4, "a b\nc", "x", 1)], "doc_id long, text string, section string, n_tokens long")
    again = token_counts.section_tokens(odd).collect()
    assert len(again) == 6 and {r[1:] for r in again} == {(0, 0, 4, 3, 0, 4), (1, 4, 1, 1, 0, 4)}
    assert token_counts.field_sections(["ab", None, "c"]) == ("ab\n\nc", [(0, 2), (3, 3), (4, 5)])
