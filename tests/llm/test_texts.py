import collections
import hashlib
import math
import random
import re
import time
import zlib

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from quillspark.llm import html_style, imatch, langid, mixing, secrets, simhash
from tests.llm.conftest import edge_rows

PIECES = public_tokenizers.path("piece_bpe_32k.model")

# ---------------------------------------------------------------- main text

PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{}</style></head><body>
<header><h1>Site</h1></header><nav><ul><li><a href=x>Home</a><li><a href=y>News</a></ul></nav>
<div class="cookie-notice">We use cookies</div><div id="sidebar"><p>Side</p></div><div class=ad>Buy!</div>
<main><article><header><h1>Head  line</h1></header><p>First <b>bold<br>para&eacute; <p>Second&nbsp;one<script>var a="</p>";</script>
<ul><li>item 1<li>item 2</ul><form><input><button>Send</button></form><table><tr><td>c1<td>c2</table></article></main>
<section class="comments"><article><p>Reader says hi</p></article></section><footer>&copy; 2024</footer></body></html>"""


def test_main_text_of_a_page():
    assert html_style.extract(html_style.parse(PAGE)) == "Head line\nFirst bold paraé\nSecond one\nitem 1\nitem 2\nc1\nc2"


def test_layout_boxes_named_like_furniture_stay():
    html = '<body><div class="with-sidebar"><main><p>kept</p></main><aside>gone</aside></div><div class="comments"><article><p>reader</p></article></div></body>'
    assert html_style.extract(html_style.parse(html)) == "kept"
    html = '<body><div id="no-ads"><article><h1>Head</h1><p>text</p></article></div><div class="ad">buy</div></body>'
    assert html_style.extract(html_style.parse(html)) == "Head\ntext"


@pytest.mark.parametrize("html", ["", None, "   ", "<", "<<>>", "<!doctype", "<p", "</p></p>", "&amp", "<script>never closed", "<div>" * 3000 + "x", "<![if]><!--", "plain text"])
def test_broken_pages(html):
    assert isinstance(html_style.extract(html_style.parse(html)), str)


@pytest.mark.parametrize("odd", ["<![ endif]-->", "<![ foo ]>", "<![x[ y ]]>", "<![if IE>", "<![CDATA[x]]>", "&#" + "9" * 5000 + ";"])
def test_text_behind_odd_declarations_stays(odd):
    got = html_style.extract(html_style.parse(f"<p>a</p>{odd}<p>b</p><p>c</p>"))
    assert got.startswith("a\n") and got.endswith("b\nc")


def test_forms_around_the_page_are_unwrapped():
    page = '<body><form id="aspnetForm"><input><nav>menu</nav>{}<select><option>one</select></form><form>search <input></form></body>'
    for own in ("<article><h1>Head</h1><p>text</p></article>", "<main><h1>Head</h1><p>text</p></main>", "<div><h1>Head</h1><p>text</p></div>"):
        assert html_style.extract(html_style.parse(page.format(own))) == "Head\ntext"


def test_parts_of_an_article_named_like_furniture_stay():
    html = '<article><h1>Head</h1><h2 id="related-work">Related</h2><section id="discussion"><p class="legal-history">law</p></section><div class="share">gone</div><p class="ad">gone</p></article>'
    assert html_style.extract(html_style.parse(html)) == "Head\nRelated\nlaw"


def test_style_tree_removes_what_all_pages_share(spark, scratch):
    random.seed(1)
    words = [f"word{k}" for k in range(500)]
    page = lambda k: f"<body><div><p>Share this with your friends</p></div><div><section><p>{' '.join(random.sample(words, 30))} {k}</p></section></div><div><span>All rights</span></div></body>"
    rows = [(k, f"http://a.example/{k}", page(k)) for k in range(40)] + [(100, "http://b.example/", page(100)), (101, None, None), (102, "http://a.example/x", "")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("key", F.lit("clash"))
    got = {r.page_id: r.text for r in html_style.main_text(df, scratch).collect()}
    assert len(got) == 43 and got[101] == "" and got[102] == ""
    assert "All rights" in got[100]  # one page tells nothing of its host
    assert all(got[k].startswith("word") and got[k].endswith(str(k)) and "\n" not in got[k] for k in range(40))


def site(k, n_menus, rng):
    """A page where tags and names say nothing: furniture is plain boxes, of ``n_menus`` kinds on the site."""
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    box = random.Random(k % n_menus)
    menu = " ".join("".join(box.choices("xyz", k=6)) for _ in range(8))
    own = [text(30), text(25)]
    html = (
        f"<body><div class=a1><span>{menu}</span></div><div class=b2><h2>Summary</h2><p>{own[0]}</p><div class=c3>Tell your friends</div><p>{own[1]}</p></div>"
        f"<div class=d4>Seen 1{k} times. {menu[::-1]}</div></body>"
    )
    return html, "Summary\n" + "\n".join(own)


def test_importance_alone_finds_the_text(spark, scratch):
    rng = random.Random(3)
    made = [site(k, 10, rng) for k in range(120)]
    rows = [(k, f"http://h.example/{k}", html) for k, (html, _) in enumerate(made)] + [(200, "http://h.example/copy", made[0][0])]
    rows += [(300 + k, "http://small.example/", site(k, 10, rng)[0]) for k in range(5)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(6)
    got = {r.page_id: r.text for r in html_style.main_text(df, scratch).collect()}
    assert [got[k] for k in range(120)] == [text for _, text in made] and got[200] == got[0]
    assert all("Tell your friends" in got[300 + k] for k in range(5))  # too few pages to tell


def bare(html):
    """A page of which no tag, role or name is known to mean anything."""
    root = html_style.parse(html)
    stack = [root]
    while stack:
        x = stack.pop()
        x.noise = "never" if x.noise == "never" else ""
        stack.extend(p for p in x.parts if isinstance(p, html_style.Node))
    return root


def merged(roots):
    """The style tree of one host by brute force: importances by the probabilities of their definition."""
    seen, places = {}, collections.defaultdict(list)
    for root in roots:
        seen.setdefault(html_style.extract(root), root)
    for root in seen.values():
        for key, shape, phrases in html_style.features(root):
            places[key].append((shape, phrases))
    out = {}
    for key, found in places.items():
        m = len(found)
        entropy = lambda counts, m=m: -sum(c / sum(counts) * math.log(c / sum(counts), m) for c in counts)
        by_phrase = collections.Counter(x for _, phrases in found for x in phrases)
        n = sum(c * words for (_, words), c in by_phrase.items())
        if m == 1:
            out[key] = (1, 1.0, 1.0)
        else:  # a phrase of c pages is as likely on each of them
            spread = sum(c * words * entropy([1] * c) for (_, words), c in by_phrase.items()) / n if n else 0.0
            out[key] = (m, entropy(list(collections.Counter(shape for shape, _ in found).values())), 1 - spread)
    return out


def test_importance_equals_brute_force(spark):
    rng = random.Random(4)
    rows = [(k, f"http://{'a' if k % 3 else 'b'}.example/", site(k % 40, 5, rng)[0] if k % 7 else "<body><p>short. Twice. short.</p></body>") for k in range(90)]
    got = html_style.importance(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)).collect()
    for host in ("a.example", "b.example"):
        want = merged([html_style.parse(html) for _, url, html in rows if host in url])
        found = {r.key: (r.pages, r.shape, r.content) for r in got if r.host == host}
        assert found.keys() == want.keys()
        assert all(found[k][0] == want[k][0] and abs(found[k][1] - want[k][1]) < 1e-9 and abs(found[k][2] - want[k][2]) < 1e-9 for k in want)


def test_the_tree_alone_gives_the_articles(spark):
    """Ablation both ways on the given pages: names off, the tree decides; and with names, small and large hosts go by one rule."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").select(html_style.host_of(F.col("url")).alias("host"), "html")
    host, _ = pages.groupBy("host").count().orderBy(F.desc("count"), "host").first()
    html = [r.html for r in pages.filter(F.col("host") == host).collect()]
    want = [html_style.extract(html_style.parse(x[x.index("<article"):x.rindex("</article>") + 10])) for x in html]
    roots = [bare(x) for x in html]
    tree = merged(roots)
    assert len(html) > 100 and [html_style.extract(r, tree, prior=False) for r in roots] == want
    assert all(html_style.extract(r, {}, prior=False) != w for r, w in zip(roots, want, strict=True))  # without tree and names nothing goes
    for n in (len(html), 60, 48, 47, 20, 5, 1):
        some = [html_style.parse(x) for x in html[:n]]
        tree = merged(some)
        assert [html_style.extract(r, tree) for r in some] == want[:n]


def test_evidence_grows_with_the_pages():
    """No number of pages changes the rule: what a page needs to go only shrinks with them."""
    drawn = [html_style._drawn(m, 0.0, html_style.PLAIN) for m in range(1, 300)]
    assert drawn == sorted(drawn, reverse=True) and max(a - b for a, b in zip(drawn, drawn[1:])) < 0.02
    assert html_style._drawn(1, 1.0, html_style.SITE) < html_style.BOUND < html_style._drawn(60, 1.0, html_style.SITE)


def test_parts_of_an_article_stay_whatever_they_repeat():
    """Headlines, items and cells that all pages have are no furniture by themselves."""
    rng = random.Random(6)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    made = [[text(20) for _ in range(2)] for _ in range(150)]
    html = "<div class=q><p>Menu of the site</p></div><article><h1>Report</h1><p>{}</p><table><tr><th>Name<th>Value<tr><td>{}<td>1</table><div class=z>Tell your friends</div></article>"
    roots = [html_style.parse(html.format(*x)) for x in made]
    tree = merged(roots)
    assert [html_style.extract(r, tree) for r in roots] == [f"Report\n{a}\nName\nValue\n{b}\n1" for a, b in made]


def test_furniture_by_name_needs_its_own_sameness_on_a_judged_host(spark, scratch):
    rng = random.Random(5)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(n))
    want, rows = {}, []
    for k in range(60):
        head, body, foot = text(4), text(40), text(10)
        html = f"<nav><a>Home</a></nav><article><h1>{head}</h1><p>{body}</p><aside>{text(3)}</aside></article><footer>Sources: {foot}</footer><div class=comments>{text(9)}</div><footer class=x>All rights 20{k}</footer>"
        rows.append((k, "http://h.example/", html))
        want[k] = f"{head}\n{body}\nSources: {foot}"
    got = {r.page_id: r.text for r in html_style.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), scratch).collect()}
    assert got == want


def test_deep_pages_take_time_in_proportion():
    deep = "<div>" * 20_000 + "<p>x</p>"
    root = html_style.parse(deep + "<b>" * 3000 + "<p>y")
    assert len(html_style.features(root)) > 20_000 and html_style.extract(root).startswith("x")


def test_pages_with_null_and_repeated_ids(spark, scratch):
    rows = [(None, "http://a.example/", "<p>one</p>"), (1, None, "<p>two</p>"), (1, None, "<p>two</p>"), (2, "no url", None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "url as judged", "url as low", "url as host", "html as text")
    got = [(r.page_id, r.text, r.n_chars) for r in html_style.main_text(df, scratch).collect()]
    assert sorted(map(repr, got)) == sorted(map(repr, [(None, "one", 3), (1, "two", 3), (1, "two", 3), (2, "", 0)]))


def test_pages_of_nothing(spark, scratch):
    assert html_style.main_text(spark.createDataFrame([], "page_id long, url string, html string"), scratch).count() == 0


# ---------------------------------------------------------------- language


def test_segmentations_are_summed():
    pieces = ["▁", "a", "b", "ab", "▁a", "ba"]
    prob = langid.np.array([[0.2], [0.1], [0.3], [0.15], [0.05], [0.2], [1e-7]])
    p = dict(zip(pieces, prob[:, 0], strict=False))

    def slow(word):
        return 1.0 if not word else sum(p[word[:k]] * slow(word[k:]) for k in range(1, len(word) + 1) if word[:k] in p)

    words = ["a", "ab", "abab", "bbaab", "ba"]
    got = langid.log_likelihood(words, langid.Vocabulary(pieces), prob)[:, 0]
    assert [round(float(x), 9) for x in got] == [round(float(langid.np.log(slow("▁" + w))), 9) for w in words]


def corpus(spark, n=600):
    random.seed(2)
    syllables = {"en": "the and ing er on th".split(), "fr": "le que eau ez ai ou".split(), "de": "der sch ung ein ich ge".split()}
    rows = []
    for k in range(n):
        lang = random.choice(sorted(syllables))
        text = " ".join("".join(random.choices(syllables[lang], k=random.randint(1, 3))) for _ in range(random.randint(5, 60)))
        rows.append((k, text, lang if k % 7 else None, "src1", len(text), lang))
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, truth string"), rows


def test_held_out_accuracy(spark):
    df, rows = corpus(spark)
    model = langid.train(df, langid.public_pieces(PIECES), per_language=100)
    truth = {r[0]: r[5] for r in rows}
    got = langid.predict(df, model).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in got)
    held = [r for r in got if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)


def test_languages_of_edge_cases(spark, edges, nothing):
    pieces = langid.public_pieces(PIECES)
    model = langid.train(edges, pieces)
    got = langid.predict(edges, model).collect()
    assert len(got) == len(edge_rows())
    und = {r[0] for r in edge_rows() if not any(c.isalpha() for c in r[1] or "")}
    assert {r.doc_id for r in got if r.lang_pred == "und"} == und
    kept = langid.keep_identified(edges, model)
    assert kept.columns == edges.columns and kept.count() == len(edge_rows()) - len(und)
    empty = langid.train(nothing, pieces)
    assert langid.predict(nothing, empty).count() == 0 and {r.lang_pred for r in langid.predict(edges, empty).collect()} == {"und"}


def test_language_stage_decides_by_the_model(spark):
    rows = [(k, "the cat sat on the mat and looked at the dog", "en") for k in range(20)] + [(k, "der Hund und die Katze sind auf dem Dach", "de") for k in range(20, 40)]
    docs = spark.createDataFrame([*rows, (40, "ωκεανός ψυχή", None), (41, "123 ...", None), (42, None, None), (43, "cat", None)], "doc_id long, text string, lang string").repartition(2)
    pieces = langid.public_pieces(PIECES)
    kept = {r.doc_id for r in langid.keep_identified(docs, langid.train(docs, pieces)).collect()}
    assert kept == {*range(40), 43}
    unlabelled = docs.withColumn("lang", F.lit(None).cast("string"))
    kept = {r.doc_id for r in langid.keep_identified(unlabelled, langid.train(unlabelled, pieces)).collect()}
    assert kept == {*range(41), 43}


def test_word_cache_is_emptied(spark, monkeypatch):
    monkeypatch.setattr(langid, "CACHE_WORDS", 3)
    df, _ = corpus(spark, 30)
    model = langid.train(df, langid.public_pieces(PIECES))
    scorer = langid._Scorer(model)
    texts = ["the and ing", "le que eau ez", "der sch ung ein", "the and ing"]
    one_by_one = [scorer.text_scores([t])[0].tolist() for t in texts]
    assert one_by_one == [s.tolist() for s in langid._Scorer(model).text_scores(texts)]


# ---------------------------------------------------------------- secrets

SLOW = {
    "assign": (re.compile(r"""((?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY]))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), 2, 6),
    "access": (re.compile("AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile("[0-9a-f]+"), 0, 24),
}


def slow_scan(text):
    found = sorted((m.start(), o, m.end(), k) for o, (k, (p, g, least)) in enumerate(SLOW.items()) for m in p.finditer(text or "") if len(m.group(g)) >= least)
    return [sum(f[3] == k for f in found) for k in SLOW], hashlib.sha256(",".join(f"{k}:{a}:{b}" for a, _, b, k in found).encode()).hexdigest()


def test_secrets_equal_python(spark, scratch):
    random.seed(4)
    bits = ["password", "Secret", "TOKEN", "api_key", "apikey", "=", ":", " ", '"', "'", "hunter2hunter2", "ab", "AKIA", "AKIA" + "Q1" * 9, "0123456789abcdef" * 2, "é😀", "\n", "\u0001", "\u0002", "secret=token:abcdefgh", "x"]
    rows = [(k, "".join(random.choices(bits, k=random.randint(0, 14))), "en", f"src{k % 4}") for k in range(800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    for r in secrets.scan(df, scratch).collect():
        assert ([r.n_assign, r.n_access, r.n_hex], r.base_sha256) == slow_scan(rows[r.doc_id][1])


def test_secrets_of_edge_cases(edges, nothing, scratch):
    got = secrets.scan(edges, scratch).collect()
    text = collections.defaultdict(set)
    for r in edge_rows():
        text[r[0]].add(r[1])
    assert len(got) == len(edge_rows())
    assert all((([r.n_assign, r.n_access, r.n_hex], r.base_sha256) in [slow_scan(t) for t in text[r.doc_id]]) for r in got)
    assert secrets.scan(nothing, scratch).count() == 0


def test_ownership_separates_examples_from_live(spark, scratch):
    shared, own = "AKIA" + "EXAMPLE0" * 2, "AKIA" + "OWNERONLY" * 2
    generic = "Zx9" + "a1B2c3" * 5
    rows = [(k, f"use {shared} here", "en", f"s{k}") for k in range(5)] + [(10, f"mine {own} and {generic}", "en", "s1"), (11, "clean words only", "en", "s2")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in secrets.scan(df, scratch).collect()}
    assert all(got[k].n_example == 1 and got[k].n_live == 0 and "access" in got[k].spans for k in range(5))
    assert got[10].n_live == 2 and "generic" in got[10].spans and got[11].spans == ""
    out = {r.doc_id: r.text for r in secrets.redact(df, scratch).collect()}
    assert out[10] == "mine [secret] and [secret]" and out[11] == rows[-1][1] and shared in out[0]


def test_redaction_keeps_rows_and_columns(edges, scratch):
    out = secrets.redact(edges, scratch)
    assert out.columns == edges.columns and out.count() == len(edge_rows())
    assert out.filter("text is not null and n_chars <> char_length(text)").count() == 0


def test_texts_with_very_many_secrets(spark, scratch):
    many = "token=abcdef1 AKIA" + "Z" * 20 + " " + "Ab1" * 10 + "\n"
    rows = [(1, many * 16_000, "en", "s1"), (2, "", "en", "s1"), (3, None, None, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    t = time.monotonic()
    got = {r.doc_id: r for r in secrets.scan(df, scratch).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "n_live").collect()}
    assert time.monotonic() - t < 60
    assert ([got[1].n_assign, got[1].n_access, got[1].n_hex], got[1].base_sha256) == slow_scan(rows[0][1]) and got[1].n_live == 48_000
    out = {r.doc_id: r.text for r in secrets.redact(df, scratch).collect()}
    assert out[1] == "[secret] [secret] [secret]\n" * 16_000 and out[2] == "" and out[3] is None


def slow_generic(text):
    """Places of long runs of letters and digits that overlap no base span, one against one."""
    base = [(m.start(), m.end()) for p, g, least in SLOW.values() for m in p.finditer(text) if len(m.group(g)) >= least]
    runs = [(m.start(), m.end()) for m in re.finditer("[A-Za-z0-9+/_-]{24,}", text) if re.search("[0-9]", m[0]) and re.search("[A-Za-z]", m[0])]
    return [(a, b) for a, b in runs if not any(x < b and a < y for x, y in base)]


def test_generic_spans_and_repositories(spark, scratch):
    random.seed(9)
    bits = ["token=", "Zx9" * 9, "0123456789abcdef" * 2, " ", "/", "AKIA" + "Q" * 20, "-" * 30, "password: hunter2hunter2"]
    rows = [(k, "".join(random.choices(bits, k=random.randint(0, 9))) + f" {k}own{k}" + "x" * 24, f"l{k % 2}", f"s{k % 2}") for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    got = {r.doc_id: r for r in secrets.scan(df, scratch).collect()}
    for k, text, _, _ in rows:  # two owners: everything looks live
        found = [tuple(map(int, s.split(":")[1:])) for s in got[k].spans.split(",") if s.startswith("generic")]
        assert found == slow_generic(text) and got[k].n_example == 0
    own = "Qq1" * 9
    rows = [(1, own, "en", "s1"), (2, own, "fr", "s1"), (3, "Rr2" * 9, "en", "s1"), (4, "Rr2" * 9, "en", "s1")]
    got = {r.doc_id: (r.n_live, r.n_spread) for r in secrets.scan(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string"), scratch).collect()}
    assert got == {1: (1, 1), 2: (1, 1), 3: (1, 0), 4: (1, 0)}


CLASHES = ("_id", "_hash", "_live", "_row", "_kept", "_epoch", "_epochs", "OWN_0", "own_1", "own_2", "rid", "doc", "epochs", "domain", "n_tokens", "live", "spans", "h", "slice", "component_id")


def test_stages_keep_columns_of_any_name(spark, edges, nothing, scratch):
    for base in (edges, nothing):
        df = base.select(*[c for c in base.columns if c not in CLASHES], *[F.lit(k).alias(c) for k, c in enumerate(CLASHES)])
        model = langid.train(df, langid.public_pieces(PIECES))
        for out in (secrets.redact(df, scratch), mixing.apply(df, scratch), simhash.keep_one(df, scratch), langid.keep_identified(df, model)):
            rows = out.collect()
            assert out.columns == df.columns and (base is edges) == (len(rows) > 0)
            assert all([r[c] for c in CLASHES] == list(range(len(CLASHES))) for r in rows)


def test_rows_of_one_key_keep_their_own_leaf(spark, scratch):
    rows = [(1, "w " * 50, "en", "src0"), (1, "w " * 60, "fr", "src1"), (None, "w " * 3, "en", "src0"), (None, "w " * 4, "fr", "src1")]
    rows += [(k, "w " * 40, "en", "src0") for k in range(10, 400)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    want = {(r.doc_id, r.source): r.epochs for r in mixing.mix(df, scratch).collect()}
    took = collections.Counter((r.doc_id, r.source) for r in mixing.apply(df, scratch).collect())
    assert {k: took[k] for k in want} == want and len(set(want.values())) > 1


def test_different_texts_of_one_key_stay(spark, scratch):
    rows = [(1, "alpha beta gamma delta"), (1, "other words are here now"), (2, "alpha beta gamma delta"), (1, "alpha beta gamma delta")]
    kept = simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string"), scratch).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == sorted(rows[:2])


# ---------------------------------------------------------------- fingerprints


def test_imatch_of_edge_cases(edges, nothing, scratch):
    got = imatch.compare(edges, scratch).collect()
    rows = edge_rows()
    assert len(got) == len(rows)
    by_text = collections.defaultdict(set)
    texts = {r[0]: r[1] or "" for r in rows}
    for r in got:
        by_text[texts[r.doc_id]].add(r.fingerprint)
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1 and r.n_chars == len(texts[r.doc_id])
    assert all(len(v) == 1 for v in by_text.values())
    assert imatch.compare(nothing, scratch).count() == 0


def test_edited_texts_and_likeness(spark, scratch):
    random.seed(6)
    words = [f"w{k}" for k in range(300)]
    rows = [(k * 3, " ".join(random.choices(words, k=random.randint(1, 120)))) for k in range(300)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
    got = imatch.compare(df, scratch).collect()
    texts = dict(rows)
    order = sorted(texts, reverse=True)
    after = {k: order[(i + 1) % len(order)] for i, k in enumerate(order)}
    for r in got:
        t, h = texts[r.doc_id], len(texts[r.doc_id]) // 2
        edited = t[: len(t) - h] + texts[after[r.doc_id]][:h]
        assert r.edited_sha256 == hashlib.sha256(edited.encode()).hexdigest()
    fps = {r.doc_id: r.fingerprint for r in got}
    assert sum(r.near_edited for r in got) > 3 * sum(r.near_next for r in got)
    assert len(set(fps.values())) == len(set(texts.values()))


def test_large_groups_of_copies_keep_their_terms(spark, scratch):
    random.seed(8)
    words = [f"w{k}" for k in range(300)]
    texts = [" ".join(random.choices(words, k=60)) for _ in range(200)]
    one, two = [f"a{k}" for k in range(60)], [f"b{k}" for k in range(60)]
    near = []
    for k in range(120):  # near copies: two words of their own each, each of them in two texts
        own = list(one)
        own[k % 60] = f"x{k // 2}"
        own[(k + 7) % 60] = f"y{k // 2}"
        near.append(" ".join(own))
    rows = list(enumerate([*texts, *near, *[" ".join(two)] * 150, " ".join([*two[:50], "w1", "w2"])]))
    got = {r.doc_id: r for r in imatch.compare(spark.createDataFrame(rows, "doc_id long, text string").repartition(7), scratch).collect()}
    group = [got[k].near_next for k in range(201, 320)]
    assert sum(group) / len(group) > 0.5
    assert got[470].near_next > 0.3 and got[470].near_next < 1  # to the exact copies beside it
    assert len(got[321].fingerprint) > 16 and got[321].fingerprint == got[322].fingerprint


# ---------------------------------------------------------------- mixing


def slow_fill(budget, children):
    """Water filling by repeated rounds: (weight, cap) to shares."""
    share, open_ = {}, dict(children)
    while open_:
        total = sum(w for w, _ in open_.values())
        full = {k: cap for k, (w, cap) in open_.items() if budget * w / total >= cap}
        if not full:
            return share | {k: int(budget * w / total) for k, (w, _) in open_.items()}
        share |= full
        budget -= sum(full.values())
        for k in full:
            del open_[k]
    return share


def test_budgets_and_prefixes(spark, scratch):
    random.seed(8)
    rows = []
    for k in range(3000):
        source = random.choices(range(8), weights=[40, 10, 10, 5, 5, 3, 2, 1])[0]
        rows.append((k, " ".join("w" for _ in range(random.randint(1, 30))), random.choice(["en", "fr"]), f"src{source}"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(6)
    got = mixing.mix(df, scratch).collect()
    assert len(got) == 3000
    leaf = collections.defaultdict(list)
    for r in got:
        leaf[r.domain, r.lang, r.source].append(r)
    tokens = {k: sum(r.n_tokens for r in v) for k, v in leaf.items()}
    weigh = lambda n: n**0.7

    def level(parent, depth):
        own = collections.defaultdict(int)
        for k, n in tokens.items():
            if k[: depth - 1] == parent:
                own[k[:depth]] += n
        return {k: (weigh(n), 2 * n) for k, n in own.items()}

    shares = slow_fill(sum(tokens.values()), level((), 1))
    shares = {k: v for p, b in shares.items() for k, v in slow_fill(b, level(p, 2)).items()}
    shares = {k: v for p, b in shares.items() for k, v in slow_fill(b, level(p, 3)).items()}
    for k, v in leaf.items():
        took = sum(r.epochs * r.n_tokens for r in v)
        assert abs(took - shares[k]) <= 15 + 2  # half a document
        assert max(r.epochs for r in v) - min(r.epochs for r in v) <= 1 and max(r.epochs for r in v) <= 2
    out = mixing.apply(df, scratch)
    assert out.columns == df.columns and out.count() == sum(r.epochs for r in got)


def test_mixing_of_edge_cases(edges, nothing, scratch):
    assert mixing.mix(edges, scratch).count() == len(edge_rows())
    assert mixing.mix(nothing, scratch).count() == 0
    assert mixing.apply(edges, scratch).columns == edges.columns


def test_imatch_counts_equal_texts_once(spark):
    rows = [(k, f"common word{k % 7} own{k}") for k in range(60)] + [(100 + k, "private pair") for k in range(5)] + [(200, "repeated row")] * 4 + [(None, None), (None, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    slow = {}
    for text in {t or "" for _, t in rows}:
        for w in set(text.split(" ")) - {""}:
            slow[w] = slow.get(w, 0) + 1
    n = len({t or "" for _, t in rows})
    want = {w: df if df > max(2, 0.25 * n) else 0 for w, df in slow.items() if df >= max(2, 0.002 * n)}
    digest = lambda w: int(hashlib.md5(w.encode()).hexdigest()[:14], 16)
    for sent in (500_000, 0):
        with pytest.MonkeyPatch.context() as m:
            m.setattr(imatch, "SENT", sent)
            assert {r.digest: r.above for r in imatch.lexicon(docs).collect()} == {digest(w): above for w, above in want.items()}
