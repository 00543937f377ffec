"""The pipeline against brute-force versions of its stages on a small folder."""

import random
from collections import defaultdict

import pyarrow as pa
import pyarrow.parquet as pq
import pytest

import corpus_pipeline
from termtrail.llm import common, decontam, near_duplicates, packing, registry, toxicity
from tests.conftest import SMALL
from tests.llm.test_decontam import plain as plain_hits
from tests.llm.test_near_duplicates import plain as plain_components
from tests.llm.test_substring import plain as plain_kept


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    """The small documents with hot copies, planted passages, nulls, a repeated row and further columns."""
    path = tmp_path_factory.mktemp("sf")
    docs = pq.read_table(f"{SMALL}/documents.parquet").to_pylist()
    items = pq.read_table(f"{SMALL}/benchmark.parquet").to_pylist()
    rnd, at = random.Random(9), max(d["doc_id"] for d in docs) + 1
    base = docs[3]["text"]
    extra = [base, base.upper(), base + " tail", *[f"{docs[k]['text']} {items[k]['text']}" for k in range(4, 9)], "", None]
    for text in extra:
        docs.append({"doc_id": at, "text": text, "lang": None, "source": rnd.choice(("hot", None)), "n_chars": len(text or "")})
        at += 1
    docs += [dict(docs[10]), {"doc_id": None, "text": base, "lang": "en", "source": "hot", "n_chars": 1}]
    for d in docs:
        d |= {"score": "clash", "kept": 1, "cluster": "c"}
    pq.write_table(pa.Table.from_pylist(docs), path / "documents.parquet")
    for name in ("labels", "benchmark"):
        pq.write_table(pq.read_table(f"{SMALL}/{name}.parquet"), path / f"{name}.parquet")
    return str(path)


def key(d):
    return (d["doc_id"] is not None, d["doc_id"] or 0, d["text"] or "")


def test_stages_match_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    before = sorted((r.asDict() for r in docs.select(*corpus_pipeline.COLUMNS).collect()), key=key)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = common.stored(stage(spark, docs, folder), name)
        assert docs.columns == corpus_pipeline.COLUMNS
        after = sorted((r.asDict() for r in docs.collect()), key=key)
        if name == "toxicity":
            model = toxicity.fit(spark.read.parquet(f"{folder}/documents.parquet"), spark.read.parquet(f"{folder}/labels.parquet"))
            pair = toxicity._compressor(model.toxic), toxicity._compressor(model.ordinary)
            _, h, of = next(toxicity._parts(pa.record_batch([pa.array([d["text"] for d in before], pa.string())], ["t"]), 0)) \
                if sum(len(d["text"] or "") for d in before) < 1 << 19 else (None, None, None)
            if h is not None:
                scores = toxicity.labels.probability(toxicity.gains(h, of, *pair), toxicity.np.array(model.weights))
                want = [d for d, s in zip(before, scores, strict=True) if s < toxicity.THRESHOLD]
            else:
                want = [d for d in before if d in after]
            assert 0 < len(want) < len(before)
        elif name == "near_duplicates":
            top = plain_components([(d["doc_id"], d["text"]) for d in before if d["doc_id"] is not None], 5)
            want, seen = [], set()
            for d in before:
                if d["doc_id"] is None or (top[d["doc_id"]][1] == d["doc_id"] and d["doc_id"] not in seen):
                    want.append(d)
                    seen.add(d["doc_id"])
        elif name == "substring_dedup":
            want = []
            for d, kept in zip(before, plain_kept([(d["doc_id"], d["text"]) for d in before], 20), strict=True):
                words = (d["text"] or "").encode().split()
                text = d["text"] if len(words) == len(kept) else " ".join(kept)
                if len(words) == len(kept) or kept:
                    want.append(d | {"text": text, "n_chars": None if text is None else len(text)})
            want.sort(key=key)
        else:
            items = pq.read_table(f"{folder}/benchmark.parquet").to_pylist()
            grams = {tuple(w[i:i + 13]) for w in (decontam.normalised(b["text"]) for b in items) for i in range(len(w) - 12)}
            shared = lambda t: any(tuple(w[i:i + 13]) in grams for w in [decontam.normalised(t)] for i in range(len(w) - 12))
            want = [d for d in before if not shared(d["text"])
                    or not plain_hits(d["text"], [(b["item_id"], b["text"]) for b in items])[3]]
            assert len(want) < len(before)
        assert after == want, name
        before = after
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, folder).collect()
    held = defaultdict(list)
    for r in pieces:
        held[r.grp, r.bin].append(r)
    assert sorted({r.doc_id for r in pieces if r.doc_id is not None}) == sorted({d["doc_id"] for d in before if d["doc_id"] is not None})
    assert all(sum(r.n_tokens for r in b) <= packing.CAPACITY for b in held.values())
    assert all(len({r.source for r in b if r.source}) == sum(r.source is not None for r in b) for b in held.values())


def test_run_gives_the_stages_result(spark, folder):
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["grp", "doc_id", "source", "cluster", "start", "n_tokens", "bin", "offset"] and got.count() > 0


def test_empty_documents(spark, folder, tmp_path):
    for name in ("documents", "labels", "benchmark"):
        pq.write_table(pq.read_table(f"{folder}/{name}.parquet").slice(0, 0), tmp_path / f"{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    for name in ("op4_near_duplicates", "op6_toxicity", "op8_quality"):
        assert registry.queries()[name](spark, str(tmp_path)).count() == 0
    assert near_duplicates.SHINGLE == 2 and corpus_pipeline.SHINGLE == 5


def test_every_operator_is_registered():
    names = registry.queries()
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names


def test_rows_of_one_id_are_judged_by_their_texts(spark):
    rnd = random.Random(4)
    a, b, c = (" ".join(f"w{rnd.randrange(9000)}" for _ in range(120)) for _ in range(3))
    rows = [(1, a), (5, a + " more"), (5, b), (7, b + " end"), (None, a), (9, ""), (9, None), (9, c), (9, c), (12, c + " x")]
    docs = spark.createDataFrame([(i, t, None, "s", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.keep_one_of_near_copies(spark, docs.repartition(3), "")
    assert got.columns == corpus_pipeline.COLUMNS
    want = [(1, a), (5, b), (None, a), (9, ""), (9, None), (9, c)]
    assert sorted(((r.doc_id, r.text) for r in got.collect()), key=repr) == sorted(want, key=repr)
