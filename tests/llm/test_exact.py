"""Operators against plain versions: whole runs of pieces, opaque values, licence windows and notices, language codes."""

import math
import random
import time
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from shockline.llm import language, licenses, pieces, quality, secrets
from shockline.llm.text import slices
from shockline.llm.tokens import vocabulary


def prose(seed, n=80):
    rng = random.Random(seed)
    return " ".join("".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 7))) for _ in range(n)) + "."


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=vocabulary("piece_bpe_32k.model"))


RUNS = ["\t", "→", "😀", "​", "\u0001", "́", "▁", " ", "\n", "\r", "-", "a", "é", "漢", "0", "→a", "a\t", "=*", "é́"]


def test_runs_of_any_character_equal_the_library(library):
    bpe = pieces.PieceBpe.of(vocabulary("piece_bpe_32k.model"))
    for unit in RUNS:
        for n in (1, 2, 3, 498, 499, 500, 2000, 100_000 // len(unit)):
            for text in (unit * n, f"x {unit * n} y"):
                assert bpe.encode(text) == library.encode(text), (unit, n)
    rng = random.Random(1)
    for _ in range(300):
        text = "".join(rng.choice(RUNS) * rng.choice([1, 2, 3, 40, 600]) for _ in range(rng.randint(1, 6)))
        ids = library.encode(text)
        assert bpe.encode(text) == ids and bpe.decode(ids) == library.decode(ids)


def test_long_runs_through_spark(spark, library):
    import hashlib

    texts = [unit * n for unit in ("\t", "→", "😀", "a\t") for n in (499, 50_000)]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)] + [(None, texts[0]), (None, texts[0])], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pieces.digest_documents(docs, vocabulary("piece_bpe_32k.model")).collect()}
    assert len(got) == len(texts) + 1
    for k, t in enumerate(texts):
        ids = library.encode(t)
        assert tuple(got[k])[1:] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())


def test_five_megabytes_of_opaque_values():
    rng = random.Random(2)
    value = lambda: "".join(rng.choices("ABCdef0123456789+/xyzXYZ", k=24))
    parts = []
    for k in range(200_000):
        parts.append(("".join(rng.choices("0123456789abcdef", k=20)), f"token={value()}", value())[k % 3])
    text = " ".join(parts)
    began = time.time()
    found = secrets.find(text)
    assert len(text) > 4_500_000 and time.time() - began < 30
    kinds = Counter(k for k, *_ in found)
    assert kinds["assign"] >= 66_666 and kinds["hex"] >= 66_667 and kinds["opaque"] > 30_000
    short = " ".join(parts[:60])
    taken = [(a, b) for k, a, b, _ in secrets.find(short) if k != "opaque"]
    want = [(m.start(), m.end()) for m in secrets.OPAQUE.finditer(short) if not any(a < m.end() and m.start() < b for a, b in taken) and any(c.isdigit() for c in m[0]) and any(c.isalpha() for c in m[0]) and secrets.entropy(m[0]) >= 3.5]
    assert [(a, b) for k, a, b, _ in secrets.find(short) if k == "opaque"] == want and want


@pytest.fixture(scope="module")
def model(spark):
    return licenses.train(spark.createDataFrame([(k, prose(k, 300) + "\n" + prose(k + 500, 30)) for k in range(80)], "doc_id long, text string"))


def test_families_are_told_apart_whatever_the_version(spark, model):
    """Every notice with other version numbers, and those of the families that share their wording with each other's numbers."""
    import re

    rows, want = [], []
    for family, texts in licenses.TEMPLATES.items():
        for text in texts:
            for version in (None, "1", "2", "2.1", "3", "3.0", "4.0"):
                new = text if version is None or "http" in text else re.sub(r"(?<=[ev] )\d(\.\d)?(?=[ ,.]|$)|(?<=-)\d\.\d(?=-|$)", lambda m: (version if "." in version else version + ".0") if "." in m[0] else version.split(".")[0], text)
                rows.append((len(rows), new))
                want.append(family)
    for name, family in (("General", "gpl"), ("Lesser General", "lgpl"), ("Affero General", "agpl")):
        for stop, version in ((";", "2"), (",", "3")):
            for body in ("This program is free software{0} you can redistribute it and/or modify it under the terms of the GNU {1} Public License as published by the Free Software Foundation{0} either version {2} of the License, or (at your option) any later version.",):
                text = body.format(":" if stop == "," else stop, name, version)
                for whole in (text, text.replace("Foundation", "Foundation\n#"), f"{text} This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY."):
                    rows.append((len(rows), whole))
                    want.append(family)
    got = {r["doc_id"]: r["families"] for r in licenses.digest(spark.createDataFrame(rows, "doc_id long, text string"), model).collect()}
    assert {rows[k][1]: (want[k], got[k]) for k in got if got[k] != want[k]} == {}


def plain_windows(h, floor, vocabulary, found):
    known, n, spans = set(vocabulary.tolist()), len(h), set()
    live = [k for k in range(n) if int(h[k]) in known and floor[k] < n]
    for t in found:
        p = [k for k in live if int(h[k]) in t.set]
        span = lambda i: [q for q in p[i:] if q < p[i] + t.reach and floor[q] == floor[p[i]]]  # noqa: B023, E731
        count = [len({int(h[q]) for q in span(i)}) for i in range(len(p))]
        good, k = [i for i in range(len(p)) if count[i] >= t.need], 0
        while k < len(good):
            near = [i for i in good[k:] if p[i] < p[good[k]] + t.reach and floor[p[i]] == floor[p[good[k]]]]
            a = max(near, key=lambda i: count[i])
            b = next(b for b in range(a, len(p) + 1) if len({int(h[q]) for q in p[a:b]}) == count[a])
            first = next(i for i in range(b - 1, -1, -1) if len({int(h[q]) for q in p[i:b]}) == count[a])
            spans.add(licenses.extended(h, floor, p[first], p[b - 1] + 1, t.words))
            k = max(k + 1, sum(i < b for i in good))
    return sorted(spans)


def licence_texts():
    rng, notices = random.Random(8), sum(licenses.TEMPLATES.values(), [])
    out = []
    for k in range(60):
        words = []
        for _ in range(rng.randint(0, 4)):
            text = rng.choice(notices).split(" ")
            text = [w for w in text if rng.random() > 0.1] if rng.random() < 0.5 else text[: rng.randint(1, len(text))]
            words += prose(rng.random(), rng.randint(0, 30)).split() + text
        out.append("".join(w + rng.choice([" ", " ", " ", " ", "\n", "\n# "]) for w in words))
    return out


def test_windows_equal_a_plain_search():
    vocab, known = licenses.templates(0.6)
    texts = licence_texts()
    run = next(slices(pa.array(texts)))
    found = licenses.paragraphs(run)
    floor = np.repeat(found.words.first[:-1], np.diff(found.words.first))
    floor[100:140] = len(floor)  # words that are taken already
    floor[140:] = np.maximum(floor[140:], 140)
    got = licenses.windows(found.words.hash, floor, vocab, known)
    assert got == plain_windows(found.words.hash, floor, vocab, known) and len(got) > 50


def test_notices_equal_a_plain_search_document_by_document(model, monkeypatch):
    vocab, known = licenses.templates(0.6)
    texts = licence_texts()
    found = licenses.paragraphs(next(slices(pa.array(texts))))
    all_at_once = licenses.notices(found, model, vocab, known, 0.5, 0.6)
    monkeypatch.setattr(licenses, "windows", plain_windows)
    alone = []
    for i, text in enumerate(texts):
        if run := next(slices(pa.array([text])), None):
            one = licenses.paragraphs(run)
            a0, l0 = int(found.words.first[i]), int(found.first[i])
            for a, b, line, family, p, share in licenses.notices(one, model, vocab, known, 0.5, 0.6):
                alone.append((a + a0, b + a0, line + l0 if line >= 0 else line, family, round(p, 6), round(share, 6)))
    assert [(a, b, k, f, round(p, 6), round(s, 6)) for a, b, k, f, p, s in all_at_once] == sorted(alone)
    assert len(alone) > 40 and len({x[3] for x in alone}) > 6


def plain_language(coder, text):
    if text is None or not any(c.isalpha() for c in text):
        return "und", 0.0
    shape = language.SHAPE[np.frombuffer(text.encode(), np.uint8)]
    x = np.zeros(language.WIDTH)
    one, two, three = language._codes
    for i in range(len(shape) - 1):
        a, b = shape[i], shape[i + 1]
        if not (a == 32 and b == 32):
            x[one[a] ^ two[b]] += 1
        if i + 2 < len(shape) and not (a == 32 and b == 32) and not (b == 32 and shape[i + 2] == 32):
            x[one[a] ^ two[b] ^ three[shape[i + 2]]] += 1
    x = np.sqrt(x) / max(math.sqrt(x.sum()), 1e-9)
    losses = []
    for word in coder.code:
        losses.append(sum(math.log1p(math.exp(-c * (float(x @ coder.weights[:, j]) + float(coder.bias[j])))) for j, c in enumerate(word)))
    best = int(np.argmin(losses))
    return coder.langs[best], 1 / sum(math.exp(losses[best] - loss) for loss in losses)


def test_language_equals_a_plain_computation(spark):
    words = {"aa": "lo mi ra tu", "bb": "xyz wqk vvj kkz", "cc": "ñandú año niña señor", "dd": "über straße grün öl", "ee": "lo wqk año öl"}
    rng = random.Random(3)
    rows = [(k, " ".join(rng.choices(words[v].split() + ["mix", "ra", "7,5"], k=rng.randint(1, 25))), v) for k, v in enumerate(sorted(words) * 30)]
    rows += [(900, None, "aa"), (901, "12 ..", "bb"), (902, "", None), (903, "a", None), (None, "lo mi", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    coder = language.train(docs)
    got = {r["doc_id"]: r for r in language.digest(docs).collect()}
    for i, text, _ in rows:
        lang, score = plain_language(coder, text)
        assert got[i]["lang_pred"] == lang and got[i]["score"] == pytest.approx(score, abs=1e-4)


def test_no_language_is_left_out_and_many_decode_in_little_memory(spark):
    rows = [(k, f"w{k:05} " * 3, f"lang{k:05}") for k in range(1200)]
    coder = language.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"), held_out=None, per_lang=1)
    assert len(coder.langs) == 1200
    best, p, gap = coder.decode(np.zeros((10_000, language.WIDTH), np.float32))
    assert best.shape == p.shape == gap.shape == (10_000,)


def test_pipeline_stages_keep_columns_of_any_name(spark, tmp_path):
    rows = [(k, "\n".join(prose(k * 7 + j, 40) for j in range(3)), "en" if k % 2 else "de", f"s{k % 3}", 9) for k in range(24)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"a.b": F.lit(1), "x y": F.lit(2), "doc": F.lit("d")})
    labels = str(tmp_path)
    spark.createDataFrame([(k, 1, 0) for k in range(24)], "doc_id long, quality int, toxic int").write.parquet(f"{labels}/labels.parquet")
    for _, stage in corpus_pipeline.STAGES[:4]:
        kept = stage(spark, docs, labels)
        assert kept.columns == docs.columns and kept.count() == 24
        assert {(r["a.b"], r["x y"], r["doc"]) for r in kept.collect()} == {(1, 2, "d")}
    assert quality.keep_quality(docs.limit(0), quality.train(docs, spark.read.parquet(f"{labels}/labels.parquet"))).count() == 0
