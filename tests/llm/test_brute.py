"""Operators that SQL cannot express against plain versions, and the pipeline's stages on odd tables."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from lectern.llm import base, decontaminate, near_dedup, quality, token_store, url_filter
from lectern.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
NAMES = ["Anna", "Boris", "Clara", "Dmitri", "Elena", "Farid"]
UNITS = ["kg", "miles", "euros"]


def canonical(text):
    """Tokens as (kind, value), told by their spelling alone."""
    out = []
    for w in text.split():
        kind = "number" if w.isdigit() else "name" if w in NAMES else "unit" if w in UNITS else "word"
        out.append((kind, w))
    return out


def contained(doc, item, width=8, share=0.6):
    """Matched tokens and changed slots at the best single offset of the item in the document, or None."""
    best = None
    form = [v if k == "word" else k for k, v in item]
    for offset in range(-len(item) + 1, len(doc)):
        hit = set()
        for i in range(len(item) - width + 1):
            if 0 <= offset + i and offset + i + width <= len(doc):
                own = doc[offset + i : offset + i + width]
                if [v if k == "word" else k for k, v in own] == form[i : i + width] and sum(k == "word" for k, _ in own) * 2 >= width:
                    hit |= set(range(i, i + width))
        slots = {(item[i][0], item[i][1], doc[offset + i][1]) for i in hit if item[i][0] != "word"}
        one_to_one = len(slots) == len({s[:2] for s in slots}) == len({(s[0], s[2]) for s in slots})
        if len(hit) >= share * len(item) and one_to_one:
            found = (len(hit), -sum(1 for i in hit if item[i][1] != doc[offset + i][1]))
            best = max(best or found, found)
    return best


def test_decontamination_against_all_pairs(spark):
    """Items word for word, re-parameterised, with slots that do not correspond, and cut short: as comparing each document with each item."""
    rng = random.Random(4)
    vocabulary = [f"v{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(500)]

    def item():
        out = [rng.choice(vocabulary) for _ in range(rng.randrange(14, 30))]
        for place in range(2, len(out) - 1, rng.randrange(4, 7)):
            out[place] = rng.choice([str(rng.randrange(10, 99)), rng.choice(NAMES), rng.choice(UNITS)])
        return out

    def changed(own, consistent):
        new = {v: v for _, v in canonical(" ".join(own))}
        for pool in ([str(n) for n in range(10, 99)], NAMES, UNITS):
            turned = pool[1:] + pool[:1]
            new |= dict(zip(pool, turned))
        return [new[v] if consistent or v in vocabulary else rng.choice(NAMES if v in NAMES else UNITS if v in UNITS else ["11", "12", "13"]) for v in own]

    items = [(i, item()) for i in range(12)]
    docs = []
    for d in range(150):
        own = list(rng.choice(items)[1])
        made = [own, changed(own, True), changed(own, False), own[: rng.randrange(6, len(own))], changed(own, True)[rng.randrange(len(own) // 2) :], []][d % 6]
        docs.append((d, [*(rng.choice(vocabulary) for _ in range(rng.randrange(1, 20))), *made, *(rng.choice(vocabulary) for _ in range(rng.randrange(1, 20)))]))
    frame = spark.createDataFrame([(d, " ".join(t), "h", "k") for d, t in docs], "doc_id long, text string, hash string, key string")
    benchmark = spark.createDataFrame([(i, " ".join(t), "x") for i, t in items], "item_id long, text string, class string")
    found = {(r["doc_id"], r["item_id"]): (r["matched"], -r["changed_slots"]) for r in decontaminate.contaminated_documents(frame, benchmark).collect()}
    expected = {(d, i): best for d, t in docs for i, own in items if (best := contained(canonical(" ".join(t)), canonical(" ".join(own))))}
    # Slots of one reading only are counted where a token is matched; both versions agree on which pairs match and how far.
    assert {k: v[0] for k, v in found.items()} == {k: v[0] for k, v in expected.items()} and len(found) > 60
    assert all((found[k][1] == 0) == (expected[k][1] == 0) for k in found)


def test_decontamination_long_texts(spark):
    item = " ".join(f"it{i}" for i in range(20))
    own = [(1, "w " * 200_000 + item + " w" * 1000), (2, "x" * 2_000_000), (None, item)]
    found = decontaminate.contaminated_documents(spark.createDataFrame(own, "doc_id long, text string"), spark.createDataFrame([(5, item), (None, None)], "item_id long, text string"))
    assert sorted(((r["doc_id"], r["item_id"], r["verbatim"]) for r in found.collect()), key=repr) == [(1, 5, True), (None, 5, True)]


MASK = 2**64 - 1


def plain_mixed(x, seed=0):
    x = (x + ((seed * 2 + 1) * 0x9E3779B97F4A7C15)) & MASK
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def plain_features(text, bits):
    words, shapes = base.Hashes(), quality.Shapes()
    split = (text or b"").split()
    w, s = [words[x] for x in split] + [0, 0], [shapes[x] for x in split] + [0, 0]
    b, c, out = 0x9DDFEA08EB382D69, 0xC2B2AE3D27D4EB4F, []
    for i in range(len(split)):
        pair = (s[i] * b + s[i + 1]) & MASK
        grams = [(w[i], 1), ((w[i] * b + w[i + 1]) & MASK, 2), (s[i], 3), (pair, 4), ((pair * c + s[i + 2]) & MASK, 5), (int(w[i] == w[i + 1]), 6)]
        out += [plain_mixed(x, seed) >> (64 - bits) for x, seed in grams]
    return out


def test_quality_against_plain_ftrl(spark):
    """Features, updates and scores as one number at a time, on texts that end in repeats, empty and null ones too."""
    rng, bits = random.Random(3), 12
    texts = [" ".join(rng.choice(["good", "Fine!", "bad", "x1", "x1", "ça"]) for _ in range(rng.randrange(0, 30))).encode() for _ in range(40)] + [b"", None, b"a a", b"a"]
    found, offsets = quality.features(texts, base.Hashes(), quality.Shapes(), bits)
    for i, text in enumerate(texts):
        assert found[offsets[i] : offsets[i + 1]].tolist() == plain_features(text, bits)
    model, z, n = quality.Ftrl(bits), {}, {}
    weight = lambda k: 0.0 if abs(z.get(k, 0.0)) <= model.l1 else (math.copysign(model.l1, z[k]) - z[k]) / ((model.beta + math.sqrt(n[k])) / model.alpha + model.l2)
    for i, text in enumerate(texts):
        own, counts = plain_features(text, bits), {}
        for k in own:
            counts[k] = counts.get(k, 0) + quality.SCALE / len(own)
        counts[1 << bits] = 1.0
        p = 1 / (1 + math.exp(-sum(weight(k) * v for k, v in counts.items())))
        for k, v in counts.items():
            w, g = weight(k), (p - i % 2) * v
            z[k] = z.get(k, 0.0) + g - (math.sqrt(n.get(k, 0.0) + g * g) - math.sqrt(n.get(k, 0.0))) / model.alpha * w
            n[k] = n.get(k, 0.0) + g * g
        model.learn(*quality._valued(found[offsets[i] : offsets[i + 1]], 1 << bits, quality.SCALE), i % 2)
    assert np.allclose(model.weights(), [weight(k) for k in range((1 << bits) + 1)], atol=1e-9)
    docs = spark.createDataFrame([(i, t.decode() if t is not None else None) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in quality.score(docs, model.weights(), bits=bits).collect():
        own = plain_features(texts[r["doc_id"]], bits)
        logit = sum(weight(k) * quality.SCALE / max(1, len(own)) for k in own) + weight(1 << bits)
        assert r["score"] == pytest.approx(1 / (1 + math.exp(-logit)), abs=1e-5)


def test_quality_held_out(spark):
    """On the driver's documents: held-out rows are told apart though their labels are never read."""
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.01/{n}.parquet") for n in ("documents", "labels"))
    rows = quality.quality_scores(docs, labels).filter("held_out").join(labels.select("doc_id", F.col("quality").alias("label")), "doc_id").collect()
    assert len(rows) > 30 and sum(r["predicted"] == r["label"] for r in rows) >= 0.9 * len(rows)


def test_quality_odd_tables(spark):
    """Long texts, null ids, labels other than 0 and 1, repeated labels and clashing columns."""
    own = [(1, "w " * 300_000, "s"), (None, "a b", "s"), (None, None, "s"), (2, "x" * 1_000_000, "s"), (2, "a", "s")]
    docs = spark.createDataFrame(own, "doc_id long, text string, score string")
    labels = spark.createDataFrame([(1, 1, "t"), (1, 0, "t"), (2, 7, "t"), (None, 1, "t"), (3, None, "t")], "doc_id long, quality int, text string")
    found = quality.quality_scores(docs, labels).collect()
    assert len(found) == 5 and all(0 <= r["score"] <= 1 for r in found) and not any(r["held_out"] for r in found if r["doc_id"] is None)


def odd_docs(spark):
    text = " ".join(f"w{i}" for i in range(80))
    own = [(None, text, None, None, None), (1, text, "en", "a", 1), (1, text, "en", "a", 1), (2, None, None, None, None), (3, "", "en", "b", 0), (4, " ".join(f"z{i}" for i in range(30_000)), "en", None, 1)]
    names = ["key", "row", "gone", "mixed", "copies", "kept", "hash", "shard", "source_size"]
    return spark.createDataFrame([(*r, *["x"] * len(names)) for r in own], DOCS + "".join(f", {n} string" for n in names))


def test_stages_on_odd_tables(spark, sf):
    """Null ids and columns, empty and long texts, repeated rows, columns with clashing names; then no rows at all."""
    docs = odd_docs(spark)
    ids = lambda df: sorted((r["doc_id"] for r in df.collect()), key=repr)
    columns = list(corpus_pipeline.COLUMNS)
    stages = dict(corpus_pipeline.STAGES)
    quality_rules, near, clean, mix, tokens = stages.values()
    kept = quality_rules(spark, docs, sf)
    assert kept.columns == columns and ids(kept) == [1, 1, 4, None]
    assert ids(near(spark, docs, sf)) == [2, 3, 4, None]
    assert ids(clean(spark, docs, sf)) == [1, 1, 2, 3, 4, None]
    mixed = mix(spark, docs, sf)
    assert mixed.columns == columns and set(ids(mixed)) <= {1, 4, None}
    assert ids(tokens(spark, docs, sf)) == [1, 1, 2, 3, 4, None]
    for stage in stages.values():
        assert stage(spark, docs.limit(0), sf).count() == 0


def test_token_ids_content(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_file())
    rows = spark.read.parquet(f"{sf}/documents.parquet").select(*corpus_pipeline.COLUMNS).orderBy("doc_id").collect()
    found = {r["doc_id"]: r for r in corpus_pipeline.token_ids(spark, spark.createDataFrame(rows, DOCS), sf).collect()}
    start = 0
    for r in rows:
        ids = np.array(tokenizer.encode(r["text"] or "", add_special_tokens=False).ids + [0], "<u4")
        assert tuple(found[r["doc_id"]])[1:] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def test_empty_tables_of_others(spark):
    empty = spark.createDataFrame([], DOCS)
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert quality.quality_scores(empty, labels).count() == 0
    pages = spark.createDataFrame([(1, "s://a/b")], "page_id long, url string")
    rules = spark.createDataFrame([], url_filter.RULES)
    assert url_filter.judge_urls(pages, rules).count() == 1 and url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_token_store_clashing_columns(spark, tmp_path):
    own = spark.createDataFrame([(2, "b c", "x", "y"), (1, "a", "x", "y"), (None, None, "x", "y"), (2, "b c", "x", "y")], "doc_id long, text string, part string, ids string")
    token_store.write_tokens(own, str(tmp_path / "t"), tokenizer_file)
    assert sorted((r["doc_id"] for r in token_store.read_tokens(spark, str(tmp_path / "t")).collect()), key=repr) == [1, 2, 2, None]


def test_near_dedup_long_texts(spark):
    long = " ".join(f"w{i}" for i in range(100_000))
    own = [(1, long), (2, long + " more"), (3, "x" * 1_000_000), (4, None)]
    assert {r["doc_id"]: r["component_id"] for r in near_dedup.near_duplicates(spark.createDataFrame(own, "doc_id long, text string")).collect()} == {1: 1, 2: 1, 3: 3, 4: 4}
