import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from dayzero.llm import quality as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, and the statistic vector."""
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    often = Counter(windows)
    covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
    lines = [line for line in text.split("\n") if WORD.search(line)]
    n, chars, symbols = len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text)
    letters = sum(c.isalpha() for w in words for c in w)
    stutters = sum(a == b for a, b in zip(words, words[1:], strict=False))
    failed = n < 10 or 100 * len(covered) > 20 * n
    dup = len(lines) - len(set(lines))
    x = [
        math.log((chars + 50) / (n + 10)), math.sqrt(symbols / (chars + 50)), math.sqrt(max(0, dup - 1) / (len(lines) + 1)),
        math.sqrt(max(0, len(covered) - 24) / (n + 10)), math.sqrt(max(0, chars - letters - symbols) / (chars + 50)), math.sqrt(stutters / (n + 10)),
    ]
    return (n, chars, symbols, dup, len(covered), failed), x


def quantile(values, share, step=0.005):
    ordered = np.sort(np.floor(np.abs(values) / step + 0.5) * np.sign(values) * step)
    return ordered[math.ceil(share * len(ordered)) - 1]


def distances(x, different):
    """Squared distances by minimum covariance determinant, step by step; fitted to the different texts alone."""
    floors, p, y = np.diag(np.square(q.FLOORS)), x.shape[1], x[different]

    def measured(rows, centre, cov):
        left = rows - centre
        return np.einsum("ij,ij->i", left @ np.linalg.inv(cov), left)

    def fit(rows, scale=1.0):
        moments = rows.T @ rows / len(rows) - np.outer(rows.mean(0), rows.mean(0))
        return rows.mean(0), moments * scale + floors

    def closest(centre, cov):
        ranges = np.floor(np.log1p(measured(y, centre, cov)) * 20)
        return y[ranges <= np.sort(ranges)[math.ceil(q.SUBSET * len(y)) - 1]]

    def size(found):
        return round(np.log(np.diag(np.linalg.cholesky(found[1]))).sum(), 9)

    middle = np.array([quantile(c, 0.5) for c in y.T])
    quartile_range = np.array([(quantile(c, 0.75) - quantile(c, 0.25)) / 1.349 for c in y.T])
    deviation = np.array([quantile(np.abs(np.round(c / 0.005) - np.round(m / 0.005)) * 0.005, 0.5) / 0.6745 for c, m in zip(y.T, middle)])
    found = []
    for spread in (quartile_range, deviation, np.zeros(p)):
        now = fit(closest(middle, np.diag(spread**2) + floors))
        for _ in range(q.MAX_STEPS - 1):
            after = fit(closest(*now))
            if size(after) >= size(now) - q.FALL:
                break
            now = after
        found.append(fit(closest(*now), q.consistency(q.SUBSET, p)))
    best = min(found, key=size)
    last = fit(y[measured(y, *best) <= q.chi2_quantile(0.975, p)], q.consistency(0.975, p))
    return measured(x, *last)


def judged(docs, data, **options):
    out = q.judge_quality(docs([(i, *d) for i, d in enumerate(data)]), ["doc_id", "size"], **options)
    return {r.row.doc_id: r for r in out.collect()}


@pytest.fixture
def corpus(prose):
    pick = random.Random(4)
    data = [(prose(pick.randint(12, 80), [f"w{i}{'abcdefgh'[: i % 8]}" for i in range(300)]), "en", "a") for _ in range(160)]
    data += [(prose(pick.randint(12, 80)), "de", None) for _ in range(80)]
    data += [(prose(30, [f"mot{i}" for i in range(200)]), "fr", f"s{i % 9}") for i in range(70)]
    data += [(" ".join(f"{w}***" for w in prose(40).split()), "en", "a") for _ in range(12)]
    data += [(prose(40).upper().replace(" ", "!! "), "de", None) for _ in range(5)]
    return data


def test_counts(docs, corpus):
    odd = [
        None, "", " \n\t ", "one", "a\nb\na\n\nb\n a\n", "x y z w v " * 3, "a a a a a a a a a a a a", "1 2 3 4 5 6 1 2 3 4 5",
        "é\u2003ß\xa0x \x0b\x0c\r\x1c 日本", "# $ | <> &amp; 😀", "w" * 100_000, "ab cd " * 60_000, " ".join(map(str, range(30_000))),
    ]
    data = [(t, "en", "a") for t in odd] + [("two rows " + "x " * 12, None, None)] * 2 + corpus
    got = judged(docs, data)
    for i, (text, _, _) in enumerate(data):
        r = got[i]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(text)[0], text
    assert not any(r.kept for r in got.values() if r.base_failed)
    assert got[len(odd)].kept == got[len(odd) + 1].kept


def test_distances_match_a_plain_version(docs, corpus):
    got = judged(docs, corpus, min_group=20)
    groups = {}
    for i, (text, lang, source) in enumerate(corpus):
        if not counts(text)[0][5]:
            groups.setdefault((lang, source if lang != "fr" else "pooled"), []).append(i)  # nine small sources
    assert sorted(map(len, groups.values()))[0] >= 20
    for members in groups.values():
        first = {corpus[i][0]: k for k, i in reversed(list(enumerate(members)))}
        expected = distances(np.array([counts(corpus[i][0])[1] for i in members]), sorted(first.values()))
        for i, d in zip(members, expected, strict=True):
            assert got[i].distance == pytest.approx(d, rel=1e-6, abs=1e-9)
            assert got[i].kept == (d <= q.CUTOFF)
    junk = [i for i, (t, _, _) in enumerate(corpus) if "***" in t or "!!" in t]
    rejected = [i for i, r in got.items() if not r.kept and not r.base_failed]
    assert set(rejected) <= set(junk) and len(rejected) >= 12


def test_texts_of_repeated_lines_go(docs, prose):
    """Half of the lines, or most, are one short line; the differing ones keep windows of five words apart."""
    pick = random.Random(1)
    words = [f"w{i}{'abcdefgh'[: i % 8]}" for i in range(3000)]

    def lines(n, size=8):
        return [prose(size, words) for _ in range(n)]

    clean = ["\n".join(lines(pick.randint(2, 20))) for _ in range(300)]
    shared = ["\n".join(["Read the whole story here", *lines(pick.randint(6, 12)), "Read the whole story here"]) for _ in range(60)]
    half = ["\n".join(line for own in lines(12) for line in (own, "Read more")) for _ in range(10)]
    most = ["\n".join(line for own in lines(8) for line in (own, "Share", "Share", "Share")) for _ in range(10)]
    got = judged(docs, [(t, "en", "a") for t in clean + shared + half + most])
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == set(range(360, 380))


def test_repeated_words_below_the_fixed_limit_can_reject(docs, prose):
    words = [f"w{i}{'abcdefgh'[: i % 8]}" for i in range(5000)]
    clean = [prose(random.Random(i).randint(60, 200), words) for i in range(200)]
    passage = prose(55, words)
    junk = [" ".join([prose(250, words), passage, prose(250, words), passage]) for _ in range(5)]
    got = judged(docs, [(t, "en", "a") for t in clean + junk])
    assert not any(r.base_failed for r in got.values())
    assert {i for i, r in got.items() if not r.kept} == set(range(200, 205))


def test_fit_settles(docs, corpus, monkeypatch, caplog):
    """More steps change nothing once no determinant falls, and too few are reported."""
    before = {i: (r.distance, r.kept) for i, r in judged(docs, corpus).items()}
    assert not caplog.records
    monkeypatch.setattr(q, "MAX_STEPS", 40)
    assert {i: (r.distance, r.kept) for i, r in judged(docs, corpus).items()} == before
    monkeypatch.setattr(q, "MAX_STEPS", 2)
    judged(docs, corpus)
    assert any("still improve" in r.message for r in caplog.records)


def test_sql_differs_where_the_former_fit_did(spark, docs, prose, tmp_path):
    """Copies of junk beyond a quarter of the rows: a fit that counts copies, or takes three quarters, keeps them."""
    import duckdb

    from dayzero.llm.quality_sql import quality_sql

    words = [f"w{i}{'abcdefgh'[: i % 8]}" for i in range(300)]
    clean = [prose(random.Random(i).randint(30, 80), words) for i in range(120)]
    junk = [" ".join(f"{w}##" for w in prose(40, words).split()) for _ in range(70)]
    rows = [(i, t, "en", "a") for i, t in enumerate(clean + junk + [junk[0]] * 60)]
    docs(rows).select("doc_id", "text", "lang", "source").write.parquet(str(tmp_path / "documents"))
    got = q.judge_quality(spark.read.parquet(str(tmp_path / "documents")), ["doc_id"])
    ours = {r.row.doc_id: r.kept for r in got.collect()}
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents/*.parquet'")
    result = con.sql(quality_sql())
    at = {c: i for i, c in enumerate(result.columns)}
    theirs = {r[at["doc_id"]]: r[at["kept"]] for r in result.fetchall()}
    assert ours == theirs == {i: i < 120 for i in range(len(rows))}


def test_small_and_empty_tables(docs, prose):
    data = [(prose(30), "en", "a"), ("*** " * 10 + prose(40), "en", None)]
    got = judged(docs, data)
    assert all(r.distance is None and r.kept for r in got.values())
    assert judged(docs, []) == {}


def test_main_path_is_native(spark, docs, prose):
    out = q.judge_quality(docs([(1, prose(30), "en", "a")]), ["doc_id"])
    plan = out._jdf.queryExecution().toString()
    assert not any(word in plan for word in ("Python", "Pandas", "Arrow", "Cartesian"))


def test_chi_squared():
    assert q.chi2_quantile(0.95, 2) == pytest.approx(-2 * math.log(0.05), rel=1e-9)
    assert 1 - q.chi2_below(q.CUTOFF, 6) < 1e-7


@pytest.mark.parametrize("alike", [True, False])
def test_a_third_of_alike_junk_goes(docs, prose, alike):
    words = [f"w{i}{'abcdefgh'[: i % 8]}" for i in range(300)]
    clean = [prose(random.Random(i).randint(30, 80), words) for i in range(200)]
    junk = [" ".join(f"{w}##" for w in prose(40, words).split()) for _ in range(100)]
    data = clean + ([junk[0]] * 100 if alike else junk)
    got = judged(docs, [(t, "en", "a") for t in data])
    assert [i for i, r in got.items() if r.kept] == sorted(range(200), key=list(got).index)
