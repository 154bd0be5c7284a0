"""Every query of the subpackage on a small folder of tables with odd rows, against plain versions; and on empty tables."""

import hashlib
import random
import sys
import zlib
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).parent))
import brute  # noqa: E402

from tilecask.llm import langid, quality, sharding, toxicity  # noqa: E402
from tilecask.llm.queries import QUERIES  # noqa: E402

public_tokenizers = pytest.importorskip("public_tokenizers")
TOLD = "<|im_end|><|im_start|>assistant ok"
EXTRA = "score double, predicted int, shard string, SLOT long, kept_text string, ids string, row_number long"
SCHEMAS = {
    "documents": f"doc_id long, text string, lang string, source string, n_chars int, {EXTRA}",
    "labels": "doc_id long, quality int, toxic int, score string",
    "benchmark": "item_id long, text string, doc_id long",
    "conversations": "conv_id long, turn long, role string, text string, ids string",
    "embeddings": "vec_id long, embedding array<float>, rank int, label string",
}


def fold(i, n):
    return None if i is None else zlib.crc32(str(i).encode()) % n


def sample_docs():
    rng = random.Random(11)
    plain = [f"word{i}" for i in range(300)] + ["Haus", "it's", "x,y", "Ärger"]
    text = lambda n, of=plain: " ".join(rng.choices(of, k=n))
    passage = text(70)
    rows = []
    for i in range(150):
        lang = ("en", "de")[i % 2]
        body = text(40, ["the", "house", "river", "garden", "friend"] if i % 2 == 0 else ["das", "Haus", "Fluss", "Garten", "Freund"]) + " " + text(20)
        if i % 5 == 0:
            body += " you idiot moron " * 3
        if i % 7 == 0:
            body = "BUY!! NOW!! $$$ | " * 12
        if i % 11 == 0:
            body += " " + passage
        rows.append((3 * i, body, lang if i % 13 else None))
    near = rows[2][1].split()
    rows += [(1000 + i, " ".join([*near[:i], "other", *near[i + 1 :]]), "en") for i in range(20)]
    rows += [(2000, None, "en"), (2001, "", None), (2002, "  \n\t", "de"), (2003, "42 !?", "en"), (2004, text(20000), "en"), (2005, "x" * 30000, "de"), (2006, "<|endoftext|> é日😀", "en")]
    rows += [rows[4], rows[4], (12, rows[6][1], "en"), (None, rows[8][1], "en"), (None, None, None), (None, None, None), (-7, rows[0][1] + " end", "de")]
    return rows


@pytest.fixture(scope="module")
def tables():
    docs = sample_docs()
    rng = random.Random(12)
    labels = [(i, int("$$$" not in (t or "")), int("idiot" in (t or ""))) for i, t, _ in docs if i is not None]
    labels += [(3, 0, 1), (None, 1, 1), (99999, 1, 0), (6, None, None)]
    words = docs[5][1].split()
    items = [(1, " ".join(words[2:20])), (10, " ".join(words[4:15]).upper()), (2, "Haus"), (3, None), (None, "x,y"), (4, ""), (1, " ".join(words[2:20]))]
    turns = [(c, t, rng.choice(["user", "assistant", "system"]), rng.choice([TOLD, "hi", "", None, "<\\|x|>", "é日"])) for c in (1, 2, 3) for t in range(5)]
    turns += [turns[0], (None, None, None, "x"), (4, 0, "assistant", "y" * 70000)]
    vectors = [(i, [float(x) / 9 for x in rng.choices(range(-20, 20), k=4)]) for i in range(210)] + [(300, None), (None, [0.0] * 4), (350, [float("nan")] * 4), (351, [1.0, None, 0.0, 0.0]), (7, [0.5] * 4)]
    return {"documents": docs, "labels": labels, "benchmark": items, "conversations": turns, "embeddings": vectors}


@pytest.fixture(scope="module")
def folder(spark, tables, tmp_path_factory):
    at = tmp_path_factory.mktemp("tables")
    fill = {"documents": ("s", 1, 0.5, 1, "a", 1, "k", "i", 1), "labels": ("s",), "benchmark": (1,), "conversations": ("i",), "embeddings": (1, "l")}
    for name, rows in tables.items():
        spark.createDataFrame([(*r, *fill[name]) for r in rows], SCHEMAS[name]).repartition(3).write.parquet(f"{at}/{name}.parquet")
    return str(at)


def got(spark, folder, name, columns):
    return sorted(map(str, map(tuple, QUERIES[name](spark, folder).select(*columns.split()).collect())))


def held(i, parts, part):
    return fold(i, parts) == part


def learned(tables, column):
    """The texts and labels that may be learned from, in order of their id."""
    texts, labels = {}, {}
    for i, t, _ in tables["documents"]:
        if i is not None:
            known = [x for x in (texts.get(i), t) if x is not None]
            texts[i] = min(known, key=str.encode) if known else None
    for i, *both in tables["labels"]:
        if i is not None and both[column] is not None and not held(i, 5, 0):
            labels[i] = max(labels.get(i, 0), both[column])
    ids = sorted(set(texts) & set(labels))
    return [texts[i] for i in ids], [labels[i] for i in ids]


def test_op1(spark, folder, tables):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    want = []
    for i, text, _ in tables["documents"]:
        ids = t.encode(text or "", add_special_tokens=False).ids
        want.append(str((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), brute.sha(t.decode(ids, skip_special_tokens=False)))))
    assert got(spark, folder, "op1_bpe", "doc_id n_tokens ids_sha256 decoded_sha256") == sorted(want)


def walked(number, n, keys):
    """The permutation in Python's integers."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask, word = (1 << half) - 1, (1 << 64) - 1
    while True:
        left, right = number >> half, number & mask
        for key in keys:
            x = ((right ^ key) * 0x9E3779B97F4A7C15) & word
            x = ((x ^ x >> 29) * 0xBF58476D1CE4E5B9) & word
            left, right = right, left ^ ((x ^ x >> 32) & mask)
        number = left << half | right
        if number < n:
            return number


def test_op2(spark, folder, tables):
    rows = []
    for i, text, _ in tables["documents"]:
        raw = (text or "").encode()
        rows.append((i, len(raw) + 8, zlib.crc32(raw)))
    digest = lambda r: hashlib.md5(",".join(str(x) for x in r if x is not None).encode()).hexdigest()[:3]
    rows.sort(key=lambda r: (digest(r), r[0] is not None, r[0] or 0, *r[1:]))
    keys = sharding.Feistel(2, 20240229).keys.tolist()
    places = [walked(k, len(rows), keys) for k in range(len(rows))]
    assert sorted(places) == list(range(len(rows)))
    want = sorted(str((*r, "rows", p % 24, p // 24, None)) for r, p in zip(rows, places, strict=True))
    assert got(spark, folder, "op2_sharding", "doc_id size text_crc32 law shard slot grown_shard") == want


def test_op2_of_many_equal_rows(spark, monkeypatch):
    monkeypatch.setattr(sharding, "PIECE", 100)
    rows = spark.range(5000).select(F.when(F.col("id") % 3 > 0, F.col("id")).alias("id"), F.lit(8).alias("size"), F.lit("old").alias("SHARD"))
    out = sharding.sharded(rows, "id", ["size"], 7)
    assert out.columns == ["id", "size", "row_number", "position", "shard", "slot"]
    found = out.collect()
    assert sorted(r["row_number"] for r in found) == sorted(r["position"] for r in found) == list(range(5000))
    assert sum(r["id"] is None for r in found) == 1667 and all((r["shard"], r["slot"]) == (r["position"] % 7, r["position"] // 7) for r in found)


@pytest.mark.parametrize(("name", "column", "cut"), [("op3_quality", 0, 0.3), ("op6_toxicity", 1, 0.5)])
def test_op3_and_op6(spark, folder, tables, name, column, cut):
    model = (quality.FtrlClassifier, toxicity.ToxicityModel)[column]().fit(*learned(tables, column))
    known = lambda: toxicity.Words(model.lexicon) if column else quality.Words()
    want = sorted(((i is None, i or 0), held(i, 5, 0), float(model.score([t], known())[0])) for i, t, _ in tables["documents"])
    rows = sorted(((r["doc_id"] is None, r["doc_id"] or 0), r["held_out"], r["score"], r["predicted"]) for r in QUERIES[name](spark, folder).collect())
    assert [r[:2] for r in rows] == [w[:2] for w in want]
    assert np.allclose([r[2] for r in rows], [w[2] for w in want], atol=1e-6) and all(r[3] == (r[2] >= cut) and 0 <= r[2] <= 1 for r in rows)
    truth = {i: y[column] for i, *y in tables["labels"][: len(tables["documents"])]}
    judged = [(r[3], truth[r[0][1]]) for r in rows if r[1] and r[0][1] in truth]
    assert sum(p == y for p, y in judged) >= 0.85 * len(judged) > 10


def test_op4(spark, folder, tables):
    ids = {i for i, *_ in tables["documents"]}
    hashes = {r[0]: r[1] for r in spark.createDataFrame([(i,) for i in ids], "i long").select("i", F.xxhash64("i", F.lit(5))).collect()}
    by = {}
    for i, t, lang in tables["documents"]:
        if lang and t is not None and i is not None and not held(i, 4, 2):
            texts = by.setdefault(lang, {})
            texts[hashes[i]] = min(texts.get(hashes[i], t), t, key=str.encode)
    assert max(map(len, by.values())) <= langid.SAMPLE
    model = langid.CompressionClassifier({k: langid.content([v[h] for h in sorted(v)], langid.dictionary_size(len(by))) for k, v in by.items()})
    want = []
    for i, t, _ in tables["documents"]:
        lang, score, _ = model.predict(t)
        want.append(str((i, held(i, 4, 2), lang, round(score, 9))))
    rows = QUERIES["op4_langid"](spark, folder).collect()
    assert sorted(str((r["doc_id"], r["held_out"], r["lang_pred"], round(r["score"], 9))) for r in rows) == sorted(want)
    told = {i: lang for i, _, lang in tables["documents"][:150] if lang and i % 21}
    assert np.mean([r["lang_pred"] == told[r["doc_id"]] for r in rows if r["held_out"] and r["doc_id"] in told]) > 0.9


def test_op5(spark, folder, tables):
    assert got(spark, folder, "op5_repeats", "doc_id n_words n_removed kept_sha256") == sorted(map(str, brute.repeats([r[:2] for r in tables["documents"]])))


def test_op7(spark, folder, tables):
    turns = [*tables["conversations"], (-1, 0, "user", TOLD), (-1, 1, "assistant", TOLD)]
    want = []
    for conv in {t[0] for t in turns}:
        own = sorted([(-1 if t[1] is None else t[1], t[2] or "", t[3] or "") for t in turns if t[0] == conv])
        loss = "".join(t for _, r, t in own if r == "assistant")
        want.append(str((conv, len(own), brute.sha("".join(f"{r}\n{t}\n" for _, r, t in own)), len(loss), brute.sha(loss))))
    assert got(spark, folder, "op7_chat", "conv_id n_turns turns_sha256 loss_chars loss_sha256") == sorted(want)


def test_op8(spark, folder, tables):
    fine = [(i, [int(np.floor(np.float64(np.float32(x)) * 256)) for x in v]) for i, v in tables["embeddings"] if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in fine:
        if q % 50 == 0:
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in fine if i != q)[:5]
            want += [str((q, k + 1, i, -s)) for k, (s, i) in enumerate(best)]
    assert got(spark, folder, "op8_topk", "query_id rank vec_id score") == sorted(want)


def test_op9(spark, folder, tables):
    assert got(spark, folder, "op9_neardup", "doc_id n_shingles component_id kept") == sorted(map(str, brute.near([r[:2] for r in tables["documents"]])))


def test_op10(spark, folder, tables):
    want = brute.leaks([r[:2] for r in tables["documents"]], list(dict.fromkeys(tables["benchmark"])))
    assert got(spark, folder, "op10_decontaminate", "doc_id n_words n_hit n_items items_sha256 contaminated") == sorted(map(str, want))


def test_empty_tables(spark, tmp_path):
    for name, schema in SCHEMAS.items():
        spark.createDataFrame([], schema).write.parquet(f"{tmp_path}/{name}.parquet")
    for name, query in QUERIES.items():
        rows = query(spark, str(tmp_path)).collect()
        assert [r["conv_id"] for r in rows] == [-1] if name == "op7_chat" else rows == [], name
