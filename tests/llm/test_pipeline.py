"""The pipeline's stages, each against what it has to do with its own input."""

import os
import re

import public_tokenizers
import pytest
from tokenizers import Tokenizer

import corpus_pipeline as P
from gridloom.llm.jaccard import JaccardJoin, jaccard_components
from gridloom.llm.toxicity import toxicity

from .test_documents import brute_jaccard, brute_kept, near_docs, sha

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """Input and output of every stage."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    for name, f in P.STAGES:
        path = str(tmp_path_factory.mktemp(name) / "t")
        f(spark, docs, SF).write.parquet(path)
        out[name] = docs, spark.read.parquet(path)
        docs = out[name][1]
    return out


def test_names(stages):
    assert list(stages) == ["toxicity", "line_dedup", "jaccard_join", "mix_sources", "bpe"] and P.ORACLE_SQL is None
    for name in list(stages)[:-1]:
        assert stages[name][1].columns == P.COLUMNS
        assert stages[name][1].schema == stages["toxicity"][0].schema


def test_toxicity(spark, stages):
    docs, out = stages["toxicity"]
    keep = {r.doc_id for r in toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 0").collect()}
    assert {r.doc_id for r in out.collect()} == keep and 0 < len(keep) < docs.count()


def test_line_dedup(stages):
    docs, out = stages["line_dedup"]
    want = {i: sha(kept) for i, n, gone, kept in brute_kept([(r.doc_id, r.text) for r in docs.collect()], short=True) if not gone or kept.strip(" \t\n\x0b\f\r")}
    got = out.collect()
    assert {r.doc_id: sha(r.text or "") for r in got} == want
    assert all(r.n_chars == len(r.text) for r in got)


def test_jaccard(stages):
    docs, out = stages["jaccard_join"]
    want = {i for i, _, c in brute_jaccard([(r.doc_id, r.text) for r in docs.collect()]) if c == i}
    assert {r.doc_id for r in out.collect()} == want


def test_jaccard_join_writes_few_files(spark, words):
    """Each file, checksum file and folder that a task makes may start a process, which counts as a second JVM until it runs its program."""
    join = JaccardJoin(spark.createDataFrame(near_docs(words, 150), "doc_id long, text string"), rare=4)
    assert join.links().count() > 0
    files = [os.path.join(d, f) for d, _, names in os.walk(join.scratch.root) for f in names]
    assert sum(f.startswith(f"{join.scratch.made[-1]}/part-") for f in files) == 1
    assert files and not [f for f in files if f.endswith(".crc")]


def test_mix_repeats_whole_documents(stages):
    docs, out = stages["mix_sources"]
    texts = {r.doc_id: r.text for r in docs.collect()}
    seen = {}
    for r in out.collect():
        assert texts[r.doc_id] == r.text
        seen[r.doc_id] = seen.get(r.doc_id, 0) + 1
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t in texts.items()}
    assert max(seen.values()) <= 3 and abs(sum(size[i] * n for i, n in seen.items()) - sum(size.values())) < 0.1 * sum(size.values())


def test_bpe(stages):
    docs, out = stages["bpe"]
    lib = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    want = sorted((r.doc_id, sha(" ".join(map(str, lib.encode(r.text or "", add_special_tokens=False).ids)))) for r in docs.collect())
    assert sorted((r.doc_id, r.ids_sha256) for r in out.collect()) == want


def test_odd_rows_pass_all_stages(spark, odd_docs, no_docs):
    for docs in (odd_docs, no_docs):
        docs = docs.select(*P.COLUMNS)
        for _, f in P.STAGES:
            docs = spark.createDataFrame((out := f(spark, docs, SF)).collect(), out.schema)
        assert docs.columns[0] == "doc_id"


def test_exact_copies_leave_nothing(spark):
    """Copies with short and blank lines, of texts with and without lines of their own; blank texts that lost nothing stay."""
    text = "Haanth.\n\nThe first paragraph is long enough to be compared.\n \t\nAnd ornd."
    texts = [text, text, "Another text, which has a line of its own.\nAnd ornd.\n", text, "Con.", "Con.", " \n\n", " \n\n", "", None, "\n" + text + "\n", text + "\nOwn."]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t) if t else 0) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    got = {r.doc_id: (r.text, r.n_chars) for r in P.line_dedup_stage(spark, docs, SF).collect()}
    second = "Another text, which has a line of its own.\n"
    assert got == {0: (text, len(text)), 2: (second, len(second)), 4: ("Con.", 4), 6: (" \n\n", 3), 7: (" \n\n", 3), 8: ("", 0), 9: (None, 0), 11: ("\n \t\nOwn.", 8)}


def test_no_copy_is_left(stages):
    """No later copy of a document comes out of line dedup, nor is any text there twice before mixing repeats documents."""
    docs, out = stages["line_dedup"]
    ids = {}
    for r in docs.collect():
        ids.setdefault(r.text, []).append(r.doc_id)
    copies = {i for t, same in ids.items() if t and t.strip() for i in same if i > min(same)}
    assert copies and not copies & {r.doc_id for r in out.collect()}
    texts = [r.text for r in stages["jaccard_join"][1].collect() if (r.text or "").strip()]
    assert len(texts) == len(set(texts))


def test_components_agree(spark, odd_docs):
    assert jaccard_components(odd_docs).count() == odd_docs.count()
