"""Stages of the pipeline one by one against plain versions, and the registered queries."""

import re
from collections import Counter

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__
import corpus_pipeline
from dayzero.llm import queries, toxicity
from dayzero.llm.common import read, written

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def stages(spark):
    """The documents before the first stage and after each one."""
    tables = [read(spark, SF, "documents")]
    for name, stage in corpus_pipeline.STAGES:
        tables.append(written(stage(spark, tables[-1], SF), name))
    return [t.toPandas() for t in tables], [t.columns for t in tables]


def test_names_and_columns(stages):
    tables, columns = stages
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "quality_rules", "near_duplicates", "mixing", "bpe"]
    assert all(c == columns[0] for c in columns[:-1])
    assert columns[-1] == ["doc_id", "n_tokens", "ids", "ids_sha256", "decoded_sha256"]


def test_filters_keep_rows_as_they_are(stages):
    tables, _ = stages
    for before, after in zip(tables[:3], tables[1:4], strict=True):
        assert 0 < len(after) < len(before)
        merged = after.merge(before, on="doc_id", suffixes=("", "_before"))
        assert len(merged) == len(after)
        assert (merged["text"] == merged["text_before"]).all()


def test_toxic_documents_go(stages, spark):
    tables, _ = stages
    model = toxicity.train(read(spark, SF, "documents"), read(spark, SF, "labels"))
    scorer = toxicity.Scorer(model)
    expected = {i for i, t in zip(tables[0]["doc_id"], tables[0]["text"], strict=True) if not t or scorer.above(t)[0] <= 0.5}
    assert set(tables[1]["doc_id"]) == expected


def test_fixed_limits_hold(stages):
    for text in stages[0][2]["text"]:
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        often = Counter(windows)
        covered = {i + k for i, w in enumerate(windows) if often[w] > 1 for k in range(5)}
        assert len(words) >= 10 and 100 * len(covered) <= 20 * len(words)


def test_one_of_each_group_stays(stages):
    before, after = stages[0][2], stages[0][3]
    sets = {}
    for i, text in zip(before["doc_id"], before["text"], strict=True):
        words = [w.lower() if w.isascii() else w for w in WORD.findall(text)]
        sets[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
    ids = sorted(sets)
    top = {i: i for i in ids}

    def find(i):
        while top[i] != i:
            i = top[i]
        return i

    for a in ids:
        for b in ids:
            common = len(sets[a] & sets[b]) if a < b else 0
            if common and common >= 0.8 * (len(sets[a]) + len(sets[b]) - common):
                low, high = sorted((find(a), find(b)))
                top[high] = low
    assert set(after["doc_id"]) == {find(i) for i in ids}


def test_mix_repeats_documents(stages):
    before, after = stages[0][3], stages[0][4]
    copies = Counter(after["doc_id"])
    assert set(copies) <= set(before["doc_id"]) and max(copies.values()) <= 3
    size = {i: len(WORD.findall(t)) for i, t in zip(before["doc_id"], before["text"], strict=True)}
    source = dict(zip(before["doc_id"], before["source"], strict=True))
    total = sum(size.values())
    taken = sum(size[i] * n for i, n in copies.items())
    assert 0.9 * total < taken <= total
    names = sorted(set(source.values()))
    whole = {s: sum(size[i] for i in size if source[i] == s) for s in names}
    mixed = {s: sum(size[i] * n for i, n in copies.items() if source[i] == s) for s in names}
    assert all(mixed[s] <= 3 * whole[s] for s in names)


def test_encoded_rows(stages):
    before, after = stages[0][4], stages[0][5]
    library = Tokenizer.from_file(public_tokenizers.path(corpus_pipeline.BPE_FILE))
    text = dict(zip(before["doc_id"], before["text"], strict=True))
    assert Counter(after["doc_id"]) == Counter(before["doc_id"])
    for i, n, ids in zip(after["doc_id"], after["n_tokens"], after["ids"], strict=True):
        assert list(ids) == library.encode(text[i], add_special_tokens=False).ids and n == len(ids)


def test_run_gives_the_same(stages, spark):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "ids_sha256").collect()
    expected = stages[0][5]
    assert Counter(map(tuple, got)) == Counter(zip(expected["doc_id"], expected["ids_sha256"], strict=True))


def test_empty_documents(spark, tmp_path):
    read(spark, SF, "labels").limit(0).write.parquet(f"{tmp_path}/labels.parquet")
    docs = read(spark, SF, "documents").limit(0)
    for name, stage in corpus_pipeline.STAGES:
        docs = written(stage(spark, docs, str(tmp_path)), name)
    assert docs.count() == 0


def test_everything_is_registered():
    names = __spark_entry__.queries()
    assert {int(n[2:].split("_")[0]) for n in names if n.startswith("op")} == set(range(1, 14))
    assert "pipeline" in names and set(queries.oracle_sql()) <= set(names)


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_queries_match_their_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for table in ("documents", "pages", "embeddings", "labels", "conversations"):
        con.sql(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    got = queries.queries()[name](spark, SF)
    expected = con.sql(queries.oracle_sql()[name])
    order = sorted(expected.columns)
    assert sorted(got.columns) == order
    ours = sorted(map(str, (tuple(r) for r in got.select(*order).collect())))
    assert ours == sorted(map(str, expected.project(", ".join(order)).fetchall()))
