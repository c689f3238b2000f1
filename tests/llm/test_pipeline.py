"""The pipeline's stages, each against plain Python on all that the one before it kept."""

from __future__ import annotations

import ast
from collections import Counter

import pyarrow as pa
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from paceline.llm import mixing, ngram_join, packing, quality, secrets
from paceline.llm.common import BATCH_ROWS, BATCH_SETTING
from tests.llm.test_mixing import targets
from tests.llm.test_ngram_join import brute as near_components
from tests.llm.test_quality import brute as base_measures
from tests.llm.test_quality import plain_verdict

STEPS = dict(corpus_pipeline.STAGES)


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    """Rows in front of and behind each stage."""
    docs, out = spark.read.parquet(f"{sf_dir}/documents.parquet"), {}
    columns = docs.columns
    for i, (name, step) in enumerate(corpus_pipeline.STAGES):
        before = docs
        docs = corpus_pipeline.keep(spark, name, lambda docs=docs, step=step: step(spark, docs, sf_dir)).table
        assert i == len(STEPS) - 1 or docs.columns == columns
        out[name] = before, docs
    return out


def rows(df):
    return Counter(map(tuple, df.collect()))


def test_order():
    assert list(STEPS) == ["quality_rules", "ngram_join", "find_secrets", "mix_sources", "pack_sequences"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_quality_rules(stages):
    before, after = stages["quality_rules"]
    references = quality.language_references(before)
    expected = Counter()
    for r in before.collect():
        *_, failed = base_measures(r.text)
        if not failed and plain_verdict(r.text.encode(), r.lang, references)[0]:
            expected[tuple(r)] += 1
    assert rows(after) == expected
    assert 0 < after.count() < before.count()


def test_one_of_each(stages):
    before, after = stages["ngram_join"]
    given = [(r.doc_id, r.text) for r in before.collect()]
    listed = near_components(given, ngram_join.SHINGLE, ngram_join.PERCENT)
    component = {i: c for i, _, c in map(ast.literal_eval, listed)}
    smallest = {}
    for i, c in component.items():
        smallest[c] = min(i, smallest.get(c, i))
    kept = set(smallest.values())
    assert rows(after) == Counter(tuple(r) for r in before.collect() if r.doc_id in kept)
    assert after.count() < before.count()


def masked(text, spans):
    """Overlapping spans are one mask."""
    out, at = [], 0
    for start, end in sorted(spans):
        if start >= at:
            out += [text[at:start], "[SECRET]"]
        at = max(at, end)
    return "".join([*out, text[at:]])


def test_secrets(stages):
    before, after = stages["find_secrets"]
    spans = {r.doc_id: [(s.start, s.end) for s in r.spans] for r in secrets.find_secrets(before).collect()}
    expected, changed = Counter(), 0
    for r in before.collect():
        base = {(a, b) for _, a, b in secrets.base_spans(r.text)}
        assert base <= set(spans[r.doc_id])
        text = masked(r.text, spans[r.doc_id])
        changed += text != r.text
        expected[(r.doc_id, text, r.lang, r.source, len(text) if spans[r.doc_id] else r.n_chars)] += 1
    assert after.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    assert rows(after) == expected
    assert changed > 0


def test_mix(stages):
    before, after = stages["mix_sources"]
    counts, taken, sizes, most = Counter(), Counter(), Counter(), Counter()
    words = {tuple(r): (r.source, len(r.text.split())) for r in before.collect()}
    for source, n in words.values():
        sizes[source] += n
        most[source] = max(most[source], n)
    for row, n in rows(after).items():
        assert row in words and n <= mixing.MOST
        counts[row] = n
        taken[words[row][0]] += n * words[row][1]
    for source, target in targets(dict(sizes), mixing.WEIGHTS, mixing.MOST).items():
        assert abs(taken[source] - target) <= mixing.MOST * most[source]


def test_pack(spark, stages):
    before, after = stages["pack_sequences"]
    tokenizer = Tokenizer.from_file(packing.tokenizer_file())
    texts = {r.doc_id: r.text for r in before.collect()}
    copies = Counter(r.doc_id for r in before.collect())
    by_copy = Counter((r.doc_id, r.start, r.length, r.ids_crc32) for r in after.collect())
    assert {k[0] for k in by_copy} == set(texts)
    assert all(n == copies[k[0]] for k, n in by_copy.items())
    single = [r for r in after.collect() if copies[r.doc_id] == 1]
    assert single
    for doc in list(texts)[:5]:
        ids = [*tokenizer.encode(texts[doc], add_special_tokens=False).ids, 1]
        assert sum(k[2] for k in by_copy if k[0] == doc) == len(ids)
    sequences = {}
    for r in after.collect():
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at
            at += length
        assert at <= packing.LENGTH


def test_run_is_the_stages_in_order(spark, sf_dir, stages):
    found = corpus_pipeline.run(spark, sf_dir)
    _, after = stages["pack_sequences"]
    assert found.columns == after.columns
    pieces = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
    assert rows(found.select(*pieces)) == rows(after.select(*pieces))


# Names that the operators use inside.
INNER = """kept n_words word_chars nearest rejected base trials passing spans row n size node root label crowd sig parity key h bits lead
 part place start rate offset copies target source_size text_hash row_hash n_shingles component_id group crcs doc_tokens sequence_id
 ids_crc32 length held_out predicted score worded _0 _1 base_failed class_distance _bucket""".split()


def odd_table(spark, odd):
    """The odd rows, a very long text and a clean one, with a column of each inner name."""
    long = [("doc_id long, text string, source string, lang string", [(70, "a long text of plain words " * 60_000, "a", "en")])]
    plain = odd.select("doc_id", "text", "source", "lang")
    for schema, more in long:
        plain = plain.unionByName(spark.createDataFrame(more, schema))
    names = [c for c in INNER if c not in plain.columns]
    given = plain.selectExpr("*", "length(text) AS n_chars", *[f"concat('{c}', coalesce(doc_id, 0)) AS `{c}`" for c in names])
    return given, names


@pytest.mark.parametrize("name", list(STEPS))
def test_odd_rows_and_clashing_columns(spark, odd, sf_dir, name):
    given, names = odd_table(spark, odd)
    found = STEPS[name](spark, given, sf_dir)
    if name == "pack_sequences":
        assert Counter(r.doc_id for r in found.where("start = 0").collect()) == Counter(r.doc_id for r in given.collect())
        return
    assert found.columns == given.columns
    source = Counter(tuple(r) for r in given.drop("text", "n_chars").collect())
    for row, n in rows(found.drop("text", "n_chars")).items():
        assert 0 < n <= source[row] * (mixing.MOST if name == "mix_sources" else 1)
    for r in found.collect():
        assert [r[c] for c in names] == [f"{c}{r.doc_id or 0}" for c in names]
    if name == "find_secrets":
        assert rows(found) == rows(given)


@pytest.mark.parametrize("name", list(STEPS))
def test_no_rows(spark, odd, sf_dir, name):
    given, _ = odd_table(spark, odd)
    assert STEPS[name](spark, given.limit(0), sf_dir).count() == 0


def test_texts_go_to_python_in_small_batches(spark, sf_dir):
    def size(batches):
        for batch in batches:
            yield pa.RecordBatch.from_pydict({"n": [batch.num_rows]})

    before = spark.conf.get(BATCH_SETTING)
    own = corpus_pipeline.run(spark, sf_dir).sparkSession
    assert max(r.n for r in own.range(0, 5000, 1, 1).mapInArrow(size, "n long").collect()) == BATCH_ROWS
    assert spark.conf.get(BATCH_SETTING) == before
    assert own.conf.get("spark.sql.shuffle.partitions") == spark.conf.get("spark.sql.shuffle.partitions")
