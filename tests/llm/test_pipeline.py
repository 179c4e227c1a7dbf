"""The pipeline's stages, each against a brute-force version of its operator."""

import hashlib
import random

import public_tokenizers
import sentencepiece
from test_decontaminate import brute as brute_passages
from test_line_dedup import brute as brute_lines
from test_near_dedup import brute as brute_near

import corpus_pipeline as cp

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def make(tmp_path, spark):
    rng = random.Random(7)
    word = lambda: "".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=rng.randint(2, 8)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(20)) for i in range(4)]
    shared = prose(12)
    texts, labels = [], []
    for i in range(500):
        bad = rng.random() < 0.2
        lines = [prose(rng.randint(3, 12)) for _ in range(rng.randint(1, 5))]
        if bad:
            lines[0] += " zorg flumox zorg"
        elif rng.random() < 0.1:
            lines.insert(rng.randint(0, len(lines)), shared)
        if rng.random() < 0.05:
            lines.append(rng.choice(items)[1])
        texts.append("\n".join(lines))
        labels.append((i, int(bad), 1))
    clean = next(i for i, r in enumerate(labels) if not r[1])
    texts += [texts[clean], texts[clean].replace("\n", " \n "), texts[clean] + " end", "", None, shared]
    docs = [(i, t, "en", "s", len(t) if t is not None else None) for i, t in enumerate(texts)]
    # near copies that are no line copies: the same words, wrapped at other places
    long = [prose(120).split() for _ in range(3)]
    for k, w in enumerate(long):
        for j, step in enumerate((5, 7)):
            t = "\n".join(" ".join(w[a : a + step]) for a in range(0, len(w), step))
            docs.append((1000 + 10 * k + j, t, "en", "s", len(t)))
    d = str(tmp_path)
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").repartition(3).write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int, quality int").write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, dict((r[0], r[1]) for r in labels), items


def test_stages(spark, tmp_path):
    d, docs, toxic, items = make(tmp_path, spark)
    frame = spark.read.parquet(f"{d}/documents.parquet")
    stages = dict(cp.STAGES)
    assert [n for n, _ in cp.STAGES] == ["toxicity", "line dedup", "near dedup", "decontamination", "sentencepiece"]

    def step(name, frame):
        path = f"{d}/{name.replace(' ', '_')}"
        stages[name](spark, frame, d).write.parquet(path)
        out = spark.read.parquet(path)
        return out, out.collect()

    frame, rows = step("toxicity", frame)
    assert frame.columns == COLUMNS
    left = {r.doc_id for r in rows}
    assert left == {r[0] for r in docs if not toxic.get(r[0])}

    before = [(r.doc_id, r.text) for r in rows]
    frame, rows = step("line dedup", frame)
    assert frame.columns == COLUMNS
    want = {k: t for k, t, n, gone in brute_lines(before) if gone == 0 or t.strip()}
    assert {r.doc_id: r.text for r in rows} == want and len(want) < len(before)
    assert all(r.n_chars == (len(r.text) if r.text is not None else None) for r in rows)

    before = [(r.doc_id, r.text) for r in rows]
    frame, rows = step("near dedup", frame)
    want = {k for k, _, _, kept in brute_near(before) if kept}
    assert {r.doc_id for r in rows} == want and len(want) < len(before) and frame.columns == COLUMNS

    before = [(r.doc_id, r.text) for r in rows]
    frame, rows = step("decontamination", frame)
    bad = {k for k, _ in brute_passages(before, items)}
    assert bad and {r.doc_id for r in rows} == want - bad and frame.columns == COLUMNS

    texts = {r.doc_id: r.text for r in rows}
    _, rows = step("sentencepiece", frame)
    lib = sentencepiece.SentencePieceProcessor(model_file=str(public_tokenizers.path("piece_bpe_32k.model")))
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in rows:
        ids = lib.encode(texts[r.doc_id] or "")
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(lib.decode(ids)))
    assert len(rows) == len(texts)
    assert sorted(map(tuple, cp.run(spark, d).collect()), key=str) == sorted(map(tuple, rows), key=str)
