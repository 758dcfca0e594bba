"""Every registered query of this part, called on small tables, against what its contract says."""

import re
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from lodegraph.llm import registry
from tests.llm.test_llm import DOCS, frame, labelled_corpus, line_sets, odd_texts, sentence, unions

import random  # isort: skip


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    """Tables with odd rows: null ids and texts, repeats, empty texts; and the same without rows."""
    rng = random.Random(4)
    docs, labels, _ = labelled_corpus(spark, 240)
    more = [(1000 + i, t, "en" if i % 2 else None, "s", None) for i, t in enumerate(odd_texts(rng))]
    more += [(None, "alpha beta gamma delta epsilon", "en", None, 5), (3, "a repeated id", "en", "s", 3), (3, "a repeated id", "en", "s", 3)]
    more += [(2000, "Released under the MIT license\nCC-BY-NC", "en", "s", 1), (2001, sentence(rng, 30), "en", "s", 1)]
    docs = docs.withColumn("lang", F.when(F.col("doc_id") % 3 == 0, "de").otherwise("en")).union(spark.createDataFrame(more, DOCS)).repartition(3)
    bench = spark.createDataFrame([(0, more[-1][1]), (1, None), (1, "x")], "item_id long, text string")
    x = np.random.default_rng(0).standard_normal((120, 8))
    vec = spark.createDataFrame([(i, [float(v) for v in r], i % 3) for i, r in enumerate(x)] + [(None, [1.0] * 8, 0), (500, None, 0)], "vec_id long, embedding array<float>, label int")
    full, none = tmp_path_factory.mktemp("full"), tmp_path_factory.mktemp("none")
    for name, df in (("documents", docs), ("labels", labels), ("benchmark", bench), ("embeddings", vec)):
        df.write.parquet(f"{full}/{name}.parquet")
        df.limit(0).write.parquet(f"{none}/{name}.parquet")
    return str(full), str(none)


def call(spark, name, where):
    key = next(k for k in registry.QUERIES if k.startswith(name + "_"))
    return registry.QUERIES[key](spark, where)


COLUMNS = {
    "op1": [("query_id", "bigint"), ("rank", "int"), ("vec_id", "bigint"), ("score", "double")],
    "op3": [("doc_id", "bigint"), ("held_out", "boolean"), ("lang_pred", "string"), ("score", "double")],
    "op5": [("doc_id", "bigint"), ("start", "bigint"), ("n_tokens", "bigint"), ("ids_crc32", "bigint")],
    "op6": [(c, "bigint") for c in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")],
    "op7": [("doc_id", "bigint"), ("n_shingles", "bigint"), ("component_id", "bigint"), ("kept", "boolean")],
    "op8": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op9": [("doc_id", "bigint"), ("held_out", "boolean"), ("score", "double"), ("predicted", "int")],
    "op10": [("doc_id", "bigint"), ("n_words", "bigint"), ("n_base", "bigint"), ("first_word", "bigint"), ("last_word", "bigint"), ("base_labels", "string"), ("labels", "string"), ("score", "double")],
}


@pytest.mark.parametrize("name", [f"op{i}" for i in range(1, 11)])
def test_no_rows(spark, tables, name):
    out = call(spark, name, tables[1])
    assert out.count() == 0 and set(COLUMNS.get(name, [])) <= set(out.dtypes)


def test_neighbours(spark, tables):
    rows = call(spark, "op1", tables[0]).collect()
    x = {r["vec_id"]: np.array(r["embedding"], dtype=np.float64) for r in spark.read.parquet(f"{tables[0]}/embeddings.parquet").collect() if r["vec_id"] is not None and r["embedding"]}
    assert {r["query_id"] for r in rows} == {i for i in x if i % 20 == 0}
    hit = 0
    for q in {r["query_id"] for r in rows}:
        own = sorted((r["rank"], r["vec_id"], r["score"]) for r in rows if r["query_id"] == q)
        want = sorted((i for i in x if i != q), key=lambda i: (-(x[i] @ x[q]), i))[:20]
        assert [o[0] for o in own] == list(range(1, 21)) and all(abs(o[2] - x[o[1]] @ x[q]) < 1e-12 for o in own)
        hit += len(set(want) & {o[1] for o in own})
    assert hit >= 0.9 * 120


@pytest.mark.parametrize(("name", "held"), [("op3", lambda i: zlib.crc32(str(i).encode()) % 3 == 1), ("op8", lambda i: zlib.crc32(str(i).encode()) % 3 == 1), ("op9", lambda i: zlib.crc32(str(i).encode()) % 5 == 0)])
def test_held_out(spark, tables, name, held):
    rows = call(spark, name, tables[0]).collect()
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").collect()
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(r["doc_id"]) for r in docs)
    assert all(r["held_out"] == (r["doc_id"] is not None and held(r["doc_id"])) and 0 <= r["score"] <= 1 for r in rows)
    if name == "op3":
        empty = {r["doc_id"] for r in docs if not any(c.isalpha() for c in r["text"] or "")}
        assert {r["doc_id"] for r in rows if r["lang_pred"] == "und"} == empty and {r["lang_pred"] for r in rows} <= {"en", "de", "und"}
    else:
        bar = {"op8": 0.7, "op9": 0.3}[name]
        assert all(r["predicted"] == int(r["score"] >= bar) for r in rows)


def test_lines_of_documents(spark, tables):
    rows = {r["doc_id"]: r for r in call(spark, "op4", tables[0]).where("doc_id is not null and doc_id <> 3").collect()}
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tables[0]}/documents.parquet").collect() if r["doc_id"] is not None}
    occ = [(d, i, s) for d, t in texts.items() for i, s in line_sets(t) if s]
    names = sorted({s for *_, s in occ})
    sets = [{s[i : i + 8] for i in range(len(s) - 7)} or {s} for s in names]
    alike = lambda a, b: len(a & b) * 100 >= 80 * len(a | b)
    of = dict(zip(names, unions(len(names), [(i, j) for i in range(len(names)) for j in range(i) if alike(sets[i], sets[j])]), strict=True))
    first, gone = {}, {}
    for d, i, s in sorted(occ):
        if of[s] in first:
            gone.setdefault(d, []).append(i)
        first.setdefault(of[s], (d, i))
    for d, r in rows.items():
        lines = texts[d].split("\n")
        own = gone.get(d, [])
        kept = "\n".join(x for i, x in enumerate(lines) if i not in own)
        assert (r["n_lines"], r["n_removed"], r["removed_lines"]) == (len(lines), len(own), own) and r["kept_chars"] == len(kept)


def test_ids_of_documents(spark, tables):
    """op5 and op6 hold all ids of every document, in order."""
    docs = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{tables[0]}/documents.parquet").collect()]
    word, byte = (Tokenizer.from_file(public_tokenizers.path(n)) for n in ("word_bpe_49k.json", "byte_bpe_50k.json"))
    crc = lambda ids: zlib.crc32(np.array(ids, "<u4").tobytes())
    five = sorted((r["start"], r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in call(spark, "op5", tables[0]).collect())
    assert [s for s, *_ in five] == np.cumsum([0, *[n for *_, n, _ in five]])[:-1].tolist()
    known = [d for _, d, *_ in five if d is not None]
    assert known == sorted(known) and five[0][1] is None
    want = sorted((str(d), len(i), crc(i)) for d, t in docs for i in [[*word.encode(t, add_special_tokens=False).ids, 1]])
    assert sorted((str(d), n, c) for _, d, n, c in five) == want
    pieces = {}
    for r in call(spark, "op6", tables[0]).where("doc_id <> 3").collect():
        pieces.setdefault(r["doc_id"], []).append((r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]))
    for d, t in docs:
        if d not in (None, 3):
            ids = [*byte.encode(t, add_special_tokens=False).ids, 0]
            own = sorted(pieces[d])
            assert [(s, crc(ids[s : s + n]), k) for s, n, _, k in own] == [(s, c, len(ids)) for s, _, c, _ in own] and sum(n for _, n, *_ in own) == len(ids)


def test_near_copies_and_licenses(spark, tables):
    seven = {r["doc_id"]: r for r in call(spark, "op7", tables[0]).where("doc_id is not null").collect()}
    assert seven[1000]["n_shingles"] == 0 and seven[1000]["kept"] and all(r["kept"] == (r["component_id"] == i) for i, r in seven.items())
    ten = {r["doc_id"]: r for r in call(spark, "op10", tables[0]).collect()}
    r = ten[2000]
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"], r["score"]) == (8, 2, 1, 5, "cc-by-nc,mit", 1.0)
    assert (ten[1000]["n_words"], ten[1000]["n_base"], ten[1000]["first_word"], ten[1000]["labels"]) == (0, 0, None, "")
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{tables[0]}/documents.parquet").collect()}
    assert all(ten[d]["n_words"] == len(re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")))) for d, t in texts.items())


def test_decontaminated(spark, tables):
    assert [(r["doc_id"], r["item_id"], r["first_word"]) for r in call(spark, "op2", tables[0]).where("item_id = 0").collect()] == [(2001, 0, 0)]


@pytest.mark.parametrize("stage", [s for _, s in corpus_pipeline.STAGES], ids=[n for n, _ in corpus_pipeline.STAGES])
def test_stages_take_odd_tables(spark, tables, stage):
    """No rows; names that operators use inside; nulls, empty texts and repeated rows."""
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet")
    clash = docs.withColumns({c: F.lit(1) for c in ("component_id", "kept", "keep_doc", "line", "h", "c", "n", "rank", "score", "label", "id", "__doc", "_odd")})
    for d in (docs, clash):
        out = stage(spark, d.limit(0), tables[0])
        assert out.count() == 0
        if stage is not corpus_pipeline.STAGES[-1][1]:
            assert out.columns == d.columns
    assert stage(spark, clash, tables[0]).count() == stage(spark, docs, tables[0]).count() > 0


def test_repeated_rows_are_packed_once(spark, tables, tmp_path):
    texts = [sentence(random.Random(i), 40) for i in range(6)]
    ids = [*range(6), 2, None]
    frame(spark, [*texts, texts[2], None], ids).write.parquet(f"{tmp_path}/documents.parquet")
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{tables[1]}/{name}.parquet").write.parquet(f"{tmp_path}/{name}.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted(str(r["doc_id"]) for r in out) == sorted(["0", "1", "2", "3", "4", "5", "None"])
