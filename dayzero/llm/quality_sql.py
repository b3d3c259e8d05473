"""The quality rules in SQL for the other engine, written out step by step.

Same steps as in quality.py, but windows of words are rows here, each document is measured by itself, and the steps that
quality.py takes until nothing improves are written out up to their largest number; those after the last improvement keep
what there is.
"""

from __future__ import annotations

import re

FLOORS = [0.06, 0.04, 0.09, 0.05, 0.06, 0.1]
N = len(FLOORS)
#: What the covariance of the closest 50 % and 97.5 % of a normal sample falls short by, and the squared
#: distance within which 97.5 % lie, for six dimensions.
SHORT_50, SHORT_975, WITHIN = 1.784455862366892, 1.0492657231950333, 14.449375335447879
CUTOFF = 45
STEPS, FALL = 12, 1e-6

COUNTS = r"""
texts AS (
    SELECT row_number() OVER () AS nr, doc_id, lang, source, coalesce(text, '') AS t FROM documents
), parts AS (
    SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g') AS bare
    FROM texts
), lines AS (
    SELECT nr, count(*) AS n_lines, count(*) - count(DISTINCT line) AS n_dup_lines
    FROM (SELECT nr, unnest(string_split(t, chr(10))) AS line FROM texts)
    WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY nr
), placed_words AS (
    SELECT nr, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM parts
), followed AS (
    SELECT nr, p, word = lag(word) OVER place AS stutter, lead(word, 4) OVER place IS NOT NULL AS whole,
           (word, lead(word, 1) OVER place, lead(word, 2) OVER place, lead(word, 3) OVER place, lead(word, 4) OVER place) AS five
    FROM placed_words WINDOW place AS (PARTITION BY nr ORDER BY p)
), stutters AS (
    SELECT nr, count(*) AS n_stutters FROM followed WHERE stutter GROUP BY nr
), repeated AS (
    SELECT nr, p FROM (SELECT * FROM followed WHERE whole) QUALIFY count(*) OVER (PARTITION BY nr, five) > 1
), covered AS (
    SELECT nr, count(DISTINCT p + k) AS n_repeat_words FROM repeated, range(0, 5) AS offsets(k) GROUP BY nr
), counts AS (
    SELECT parts.nr, doc_id, lang, source, len(w) AS n_words, length(bare) AS word_chars,
           length(bare) - length(regexp_replace(bare, '[#*$%&|<>]', '', 'g')) AS n_symbols,
           length(regexp_replace(bare, '\P{L}+', '', 'g')) AS n_letters,
           coalesce(n_lines, 0) AS n_lines, coalesce(n_dup_lines, 0) AS n_dup_lines,
           coalesce(n_repeat_words, 0) AS n_repeat_words,
           coalesce(n_stutters, 0) AS n_stutters
    FROM parts LEFT JOIN lines USING (nr) LEFT JOIN covered USING (nr) LEFT JOIN stutters USING (nr)
), rates AS (
    SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed,
           ln((word_chars + 50) / (n_words + 10)) AS x0, sqrt(n_symbols / (word_chars + 50)) AS x1,
           sqrt(greatest(n_dup_lines - 1, 0) / (n_lines + 1)) AS x2,
           sqrt(greatest(n_repeat_words - 24, 0) / (n_words + 10)) AS x3,
           sqrt(greatest(word_chars - n_letters - n_symbols, 0) / (word_chars + 50)) AS x4,
           sqrt(n_stutters / (n_words + 10)) AS x5
    FROM counts
), sizes AS (
    SELECT lang, source, count(*) FILTER (NOT base_failed) AS n FROM rates GROUP BY lang, source
), levels AS (
    SELECT *, CASE WHEN n >= 50 THEN 0
                   WHEN sum(n) FILTER (n < 50) OVER (PARTITION BY lang) >= 50 THEN 1 ELSE 2 END AS level
    FROM sizes
), groups AS (
    SELECT lang, source, level < 2 OR sum(n) OVER (PARTITION BY level) >= 50 AS fitted,
           (level, CASE WHEN level < 2 THEN lang END, CASE WHEN level = 0 THEN source END)::VARCHAR AS gid
    FROM levels
), known AS (
    SELECT r.*, g.gid, g.fitted FROM rates r JOIN groups g
      ON r.lang IS NOT DISTINCT FROM g.lang AND r.source IS NOT DISTINCT FROM g.source
), vectors AS (
    SELECT DISTINCT ON (gid, t) known.* FROM known JOIN (SELECT nr, t FROM texts) USING (nr) WHERE fitted AND NOT base_failed
)"""


def _staged(source: str, stages: list[list[str]]) -> str:
    """source with more columns, stage by stage; each stage may use those before it."""
    for columns in stages:
        source = f"(SELECT *, {', '.join(columns)} FROM {source})"
    return source


def _cholesky(cov) -> list[list[str]]:
    """Columns l{i}{j} of the factor of the matrix whose entries cov(i, j) names: each column's top first."""
    out = []
    for j in range(N):
        left = [f"({cov(i, j)})" + "".join(f" - l{i}{k} * l{j}{k}" for k in range(j)) for i in range(j, N)]
        out.append([f"sqrt(greatest({left[0]}, 1e-8)) AS l{j}{j}"])
        if j < N - 1:
            out.append([f"({left[i - j]}) / l{j}{j} AS l{i}{j}" for i in range(j + 1, N)])
    return out


def _measured(rows: str, fit: str, keys: str) -> str:
    """Squared distances of rows to the fit, or to each of the fits, of their group."""
    steps = []
    for i in range(N):
        left = f"x{i} - m{i}" + "".join(f" - l{i}{j} * z{j}" for j in range(i))
        steps.append([f"({left}) / l{i}{i} AS z{i}"])
    squares = " + ".join(f"z{i} * z{i}" for i in range(N))
    kept = ", ".join(f"x{i}" for i in range(N))
    joined = f"(SELECT * FROM {rows} LEFT JOIN {fit} USING (gid))"
    return f"SELECT nr, {keys}, {kept}, {squares} AS d2 FROM {_staged(joined, steps)}"


def _sums() -> dict[str, str]:
    sums = {"n": "count(*)"} | {f"s{i}": f"sum(x{i})" for i in range(N)}
    return sums | {f"q{i}{j}": f"sum(x{i} * x{j})" for i in range(N) for j in range(i + 1)}


def _fit(sums: str, scale: float, keys: str) -> str:
    def cov(i: int, j: int) -> str:
        plain = f"(q{i}{j} / n - m{i} * m{j}) * {scale!r}"
        return f"greatest({plain}, 0) + {FLOORS[i] ** 2!r}" if i == j else plain

    means = [f"s{i} / n AS m{i}" for i in range(N)]
    size = "round(" + " + ".join(f"ln(l{i}{i})" for i in range(N)) + ", 9) AS size"
    return f"SELECT {keys}, {', '.join(NUMBERS)}, {size} FROM {_staged(sums, [means, *_cholesky(cov)])}"


NUMBERS = [f"m{i}" for i in range(N)] + [f"l{i}{j}" for i in range(N) for j in range(i + 1)]


def _half(name: str, fit: str, scale: float) -> list[str]:
    """Fit, named `name`, to the closest half of each group's texts under another fit, for each start."""
    sums = _sums()
    summed = ", ".join(f"{v} AS {c}" for c, v in sums.items())
    nearer = ", ".join(f"sum({c}) OVER nearer AS {c}" for c in sums)
    return [
        f"{name}_far AS ({_measured('vectors', fit, 'gid, start')})",
        f"{name}_range AS (SELECT gid, start, floor(ln(1 + d2) * 20) AS r, {summed} FROM {name}_far GROUP BY gid, start, r)",
        f"""{name}_near AS (
    SELECT gid, start, r, sum(n) OVER (PARTITION BY gid, start) AS total, {nearer}
    FROM {name}_range WINDOW nearer AS (PARTITION BY gid, start ORDER BY r ROWS UNBOUNDED PRECEDING)
), {name}_half AS (
    SELECT * FROM {name}_near WHERE n >= 0.5 * total QUALIFY row_number() OVER (PARTITION BY gid, start ORDER BY r) = 1
)""",
        f"{name} AS ({_fit(f'{name}_half', scale, 'gid, start')})",
    ]


def quality_sql() -> str:
    steps = [COUNTS]
    quartiles = []
    for i in range(N):
        quartiles.append(
            f"SELECT gid, {i} AS dim, b, count(*) AS n FROM (SELECT gid, round(x{i} * 200) AS b FROM vectors) GROUP BY gid, b"
        )
    steps.append("bins AS (" + " UNION ALL ".join(quartiles) + ")")
    steps.append("""placed AS (
    SELECT gid, dim, b, sum(n) OVER (PARTITION BY gid, dim ORDER BY b) AS through, sum(n) OVER (PARTITION BY gid, dim) AS total
    FROM bins
), spreads AS (
    SELECT gid, dim, min(b) FILTER (through >= 0.5 * total) / 200 AS middle,
           (min(b) FILTER (through >= 0.75 * total) / 200 - min(b) FILTER (through >= 0.25 * total) / 200) / 1.349 AS spread0
    FROM placed GROUP BY gid, dim
), off AS (
    SELECT gid, dim, abs(b - round(middle * 200)) AS b, sum(n) AS n
    FROM bins JOIN spreads USING (gid, dim) GROUP BY ALL
), off_placed AS (
    SELECT gid, dim, b, sum(n) OVER (PARTITION BY gid, dim ORDER BY b) AS through, sum(n) OVER (PARTITION BY gid, dim) AS total
    FROM off
), off_spreads AS (
    SELECT gid, dim, min(b) FILTER (through >= 0.5 * total) / 200 / 0.6745 AS spread1 FROM off_placed GROUP BY gid, dim
), starts AS (
    SELECT gid, dim, middle, 0 AS start, spread0 AS spread FROM spreads
    UNION ALL
    SELECT gid, dim, middle, 1, spread1 FROM spreads JOIN off_spreads USING (gid, dim)
    UNION ALL
    SELECT gid, dim, middle, 2, 0 FROM spreads
)""")
    starts = [f"max(middle) FILTER (dim = {i}) AS m{i}" for i in range(N)]
    starts += [f"sqrt(max(spread * spread) FILTER (dim = {i}) + {FLOORS[i] ** 2!r}) AS l{i}{i}" for i in range(N)]
    starts += [f"0.0::DOUBLE AS l{i}{j}" for i in range(N) for j in range(i)]
    steps.append(f"fit0 AS (SELECT gid, start, {', '.join(starts)} FROM starts GROUP BY gid, start)")
    steps += _half("fit1", "fit0", 1.0)
    for k in range(2, STEPS + 1):
        steps += _half(f"new{k}", f"fit{k - 1}", 1.0)
        better = ", ".join(
            f"CASE WHEN a.size < b.size - {FALL!r} THEN a.{c} ELSE b.{c} END AS {c}" for c in [*NUMBERS, "size"]
        )
        steps.append(f"fit{k} AS (SELECT gid, start, {better} FROM new{k} a JOIN fit{k - 1} b USING (gid, start))")
    steps += _half("scaled", f"fit{STEPS}", SHORT_50)
    steps.append("best AS (SELECT * EXCLUDE (start) FROM scaled QUALIFY row_number() OVER (PARTITION BY gid ORDER BY size, start) = 1)")
    summed = ", ".join(f"{v} AS {c}" for c, v in _sums().items())
    steps.append(f"best_far AS ({_measured('vectors', 'best', 'gid')})")
    steps.append(f"most AS (SELECT gid, {summed} FROM best_far WHERE d2 <= {WITHIN!r} GROUP BY gid)")
    steps.append(f"last_fit AS ({_fit('most', SHORT_975, 'gid')})")
    judged = _measured("(SELECT * FROM known WHERE fitted AND NOT base_failed)", "last_fit", "gid")
    steps.append(f"judged AS ({judged})")
    # Each step is read by several later ones, so it is kept rather than computed again for each.
    kept = re.sub(r"(\w+) AS \((?=\s*SELECT)", r"\1 AS MATERIALIZED (", ",\n".join(steps))
    return (
        "WITH "
        + kept
        + f"""
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND coalesce(d2 <= {CUTOFF}, true) AS kept
FROM known LEFT JOIN judged USING (nr)"""
    )
