"""The pipeline's stages on a small table: each decision takes effect, clean documents stay."""

import pickle
import random

import numpy as np
import pytest

import corpus_pipeline
from scanloom.llm import bpe, quality
from scanloom.llm.queries import oracle_sql, queries, tokenizer_path

WORDS = [a + b for a in ("ka", "lo", "mi", "ru", "te", "zo") for b in ("ran", "sel", "tim", "von", "wex", "yad", "pil")]


def prose(seed, n):
    rng = random.Random(seed)
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("tables")
    rows, labels = [], []
    for i in range(120):
        words = prose(i, 60).split()
        if i % 3 == 0:
            words[5] = words[20] = words[40] = "idiot"
        if i % 3 == 1:
            words = [w + "###" for w in words]
        rows.append((i, " ".join(words)))
        labels.append((i, int(i % 3 == 2), int(i % 3 == 0)))
    rows += [(500, prose(2, 60)), (501, prose(2, 60) + " more"), (502, prose(901, 60) + " " + prose(7000, 13)), (503, prose(902, 30) + ' token = "0123456789abcdef0123456789abcdef" ' + prose(903, 30)), (504, None)]
    full = [(i, t, "en", "s", len(t) if t else 0) for i, t in rows]
    spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([(1, prose(7000, 13))], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages(spark, folder):
    docs, kept = spark.read.parquet(f"{folder}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        kept[name] = {r["doc_id"]: r for r in docs.collect()}
        if name != "encode":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    clean = {i for i in range(120) if i % 3 == 2}
    assert clean <= set(kept["quality"]) and not {i for i in range(120) if i % 3 != 2} & set(kept["quality"])
    assert clean <= set(kept["near_copies"]) and not {500, 501} & set(kept["near_copies"])
    assert 502 in kept["near_copies"] and 502 not in kept["decontaminate"] and clean <= set(kept["decontaminate"])
    assert "0123456789abcdef" not in kept["secrets"][503]["text"] and kept["secrets"][2]["text"] == prose(2, 60)
    assert kept["secrets"][503]["n_chars"] == len(kept["secrets"][503]["text"])
    load = bpe.load(tokenizer_path())
    assert all(bytes(r["ids"]) == load.encode(kept["secrets"][i]["text"]) for i, r in kept["encode"].items())


def test_run_applies_all_stages(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    assert {r["doc_id"] for r in out} >= {2, 503} and not {r["doc_id"] for r in out} & {0, 1, 501, 502}
    assert all(len(np.frombuffer(r["ids"], "<u4")) == r["n_tokens"] for r in out)


def test_driver_holds_no_sample_and_no_large_bitmap(spark, folder, monkeypatch):
    frame, context = type(spark.range(1)), type(spark.sparkContext)
    collected, sent = [], []

    def sizes(rows):
        return [n for r in rows if (n := sum(len(v) for v in r if isinstance(v, (bytes, bytearray))))]

    def recorded(real):
        def run(self, *args):
            rows = list(real(self, *args))
            collected.append(sizes(rows))
            return iter(rows) if real is streamed else rows

        return run

    streamed, broadcast = frame.toLocalIterator, context.broadcast
    monkeypatch.setattr(frame, "collect", recorded(frame.collect))
    monkeypatch.setattr(frame, "toLocalIterator", recorded(streamed))
    monkeypatch.setattr(context, "broadcast", lambda self, value: sent.append(len(pickle.dumps(value))) or broadcast(self, value))
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    corpus_pipeline.grade(spark, docs, folder)
    # fits come in, and the model goes out
    assert max(map(len, collected)) <= quality.FOLDS + 1 and len(sent) == 1
    collected.clear(), sent.clear()
    corpus_pipeline.drop_near_copies(spark, docs, folder)
    assert sent and max(sent) < 1 << 16 and max(map(sum, collected)) < 1 << 16


CLASHING = "doc_id long, text string, lang string, source string, n_chars long, row string, spans string, items map<string,int>, selected int, several long, component_id long, n long"


@pytest.fixture(scope="module")
def odd(spark, tmp_path_factory):
    out = tmp_path_factory.mktemp("odd")
    texts = [(1, prose(1, 30)), (1, prose(1, 30)), (2, None), (2, None), (3, ""), (None, prose(1, 30)), (None, None), (4, prose(4, 30000)), (5, prose(5, 40)), (5, prose(6, 40)), (6, prose(6, 40)), (7, "\n \t")]
    rows = [(i, t, None, None, len(t) if t else None, "r", "x", {"a": k}, 1, 2, 3, 4) for k, (i, t) in enumerate(texts)]
    spark.createDataFrame(rows, CLASHING).write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame([(1, None, 0), (None, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{out}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out)


def test_stages_on_odd_rows(spark, odd):
    docs = spark.read.parquet(f"{odd}/documents.parquet")
    key = lambda r: (r["doc_id"], r["text"])
    given = sorted(map(key, docs.collect()), key=str)
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, odd)
        if name == "encode":
            assert out.count() == len(given)
            continue
        assert out.dtypes == docs.dtypes, name
        got = sorted(map(key, out.collect()), key=str)
        if name == "near_copies":
            # one row for the group of 1, one for 5 and 6, which has a text of its own besides
            want = [(1, prose(1, 30)), (2, None), (2, None), (3, ""), (None, prose(1, 30)), (None, None), (4, prose(4, 30000)), (5, prose(5, 40)), (5, prose(6, 40)), (7, "\n \t")]
            assert got == sorted(want, key=str)
        else:
            assert got == given, name
        assert stage(spark, docs.limit(0), odd).count() == 0, name
    assert corpus_pipeline.encode(spark, docs.limit(0), odd).count() == 0


def test_every_operator_is_registered():
    found = {int(k[2:].split("_")[0]) for k in queries() if k.startswith("op")}
    assert found == set(range(1, 14)) and set(oracle_sql()) <= set(queries())
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "decontaminate", "secrets", "encode"]
