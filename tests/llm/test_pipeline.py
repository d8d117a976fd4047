import corpus_pipeline
import public_tokenizers
from tokenizers import Tokenizer

from dialoom.llm import linededup, mixing, neardup
from dialoom.llm.storage import documents_schema, stored, table
from tests.llm.helpers import ODD, documents, with_clashes


def staged(spark, docs, sf_dir):
    out = {"documents": docs}
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
        out[name] = docs
    return out


def ids_of(frame):
    return sorted(r.doc_id for r in frame.select("doc_id").collect())


def test_stages_on_the_small_table(spark):
    sf_dir = "/root/testdata/sf0.001"
    out = staged(spark, table(spark, sf_dir, "documents"), sf_dir)
    for name in ("language_id", "line_dedup", "near_dedup", "mix"):
        assert out[name].columns == documents_schema()
    assert ids_of(out["language_id"]) == ids_of(out["documents"])  # all have letters
    left = {r.doc_id: r.text for r in linededup.op7_linededup(out["language_id"]).collect()}
    own = {r.doc_id: r for r in out["line_dedup"].collect()}
    assert set(own) == {i for i, t in left.items() if any(c.isalpha() for c in t)}
    assert all(own[i].text == left[i] and own[i].n_chars == len(left[i]) for i in own)
    kept = {r.doc_id for r in neardup.op10_neardup(out["line_dedup"]).filter("kept").collect()}
    assert ids_of(out["near_dedup"]) == sorted(kept)
    taken = {r.doc_id: r.taken // max(r["size"], 1) for r in mixing.op3_mixing(out["near_dedup"]).collect()}
    assert ids_of(out["mix"]) == sorted(i for i, n in taken.items() for _ in range(n))
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = sum(len(tokenizer.encode(r.text, add_special_tokens=False).ids) + 1 for r in out["mix"].collect())
    pieces = out["pack"].toPandas()
    assert pieces.length.sum() == want and pieces.groupby("sequence_id").length.sum().max() <= 1024
    assert pieces.sequence_id.nunique() <= 1.05 * want / 1024 + 2


def test_run_equals_the_stages(spark):
    sf_dir = "/root/testdata/sf0.001"
    key = ["doc_id", "piece", "start", "length", "ids_crc32"]
    a = sorted(map(tuple, corpus_pipeline.run(spark, sf_dir).select(*key).collect()))
    assert a == sorted(map(tuple, staged(spark, table(spark, sf_dir, "documents"), sf_dir)["pack"].select(*key).collect()))


def test_odd_rows_and_nothing(spark):
    docs = with_clashes(documents(spark, ODD))
    out = staged(spark, docs, "/nowhere")
    assert set(ids_of(out["language_id"])) == {i for i, t in enumerate(ODD) if t and any(c.isalpha() for c in t)}
    assert out["pack"].count() > 0
    assert staged(spark, documents(spark, []), "/nowhere")["pack"].count() == 0
