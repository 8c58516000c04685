import random
import re
from collections import Counter, defaultdict

from quillspark.llm import divergence
from tests.llm.conftest import edge_rows


def slow(rows, least=30, top=50):
    """Rows (text, lang, source): every group has every kept term."""
    docs, count, groups = defaultdict(Counter), defaultdict(Counter), set()
    for text, lang, source in rows:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        said = re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
        docs[lang].update(set(said))
        count[lang, source].update(said)
    out = []
    for lang in {x for x, _ in groups}:
        kept = [t for t, n in docs[lang].items() if n >= least]
        own = [s for x, s in groups if x == lang]
        share = {}
        for name, c in [(s, count[lang, s]) for s in own] + [(None, sum((count[lang, s] for s in own), Counter()))]:
            total = sum(c[t] for t in kept)
            share[name] = {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}
        for s in own:
            far = sorted((-sum(abs(share[s][t] - share[o][t]) for t in kept), o.encode()) for o in own if o != s)
            out += [(lang, s, "pair", o.decode(), -v, k + 1) for k, (v, o) in enumerate(far)]
            more = sorted((share[None][t] - share[s][t], t.encode()) for t in kept if count[lang, s][t] and share[s][t] > share[None][t])
            out += [(lang, s, "term", t.decode(), -v, k + 1) for k, (v, t) in enumerate(more[:top])]
    return sorted(out)


def run(df, scratch, **kw):
    return sorted(tuple(r) for r in divergence.audit(df, scratch, **kw).collect())


def test_equals_brute_force(spark, scratch):
    random.seed(9)
    words = [f"{a}{b}{c}" for a in "kmnp" for b in "aeiou" for c in "lrst"]
    rows = []
    for n in range(700):
        lang, source = ("en", "de", None, "xx")[n % 4], ("s1", "s1", "s2", "s3", None, f"r{n % 9}")[n % 6]
        lean = words if n % 3 else words[: 20 + n % 11]
        rows.append((" ".join(random.choice(lean).upper() if random.random() < 0.2 else random.choice(lean) for _ in range(n % 60)), lang if lang != "xx" else f"x{n % 5}", source))
    rows += [("Über Größe, déjà-vu_x", "fr", "a")] * 31 + [("only digits 123", "fr", "b"), (None, "fr", "c"), ("", "fr", "größe"), ("über", "fr", "Z")]
    df = spark.createDataFrame([(t, a, b, 1, 2, "x", 3) for t, a, b in rows], "text string, lang string, source string, n int, p int, term string, total int").repartition(6)
    got = run(df, scratch, terms=20)
    assert got == slow(rows, top=20)
    assert {r[2] for r in got} == {"pair", "term"} and max(r[5] for r in got if r[2] == "term") == 20


def test_edges(edges, scratch):
    rows = [(r[1], r[2], r[3]) for r in edge_rows()]
    for least in (1, 2, 30):
        assert run(edges, scratch, least=least) == slow(rows, least)


def test_plain_join_for_many_groups(edges, scratch, monkeypatch):
    monkeypatch.setattr(divergence, "SENT", 0)
    assert run(edges, scratch, least=1) == slow([(r[1], r[2], r[3]) for r in edge_rows()], 1)


def test_nothing(nothing, scratch):
    assert run(nothing, scratch) == []
