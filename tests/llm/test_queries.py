"""Each query over hard rows against a brute-force version in plain Python."""

import hashlib
import re
import zlib

import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from ledgerleaf.llm import queries as Q
from ledgerleaf.llm.tokens import vocabulary


def result(spark, name, sf_dir):
    return [r.asDict() for r in Q.QUERIES[name](spark, sf_dir).collect()]


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_empty_tables(spark, empty_dir, name):
    assert result(spark, name, empty_dir) == []


@pytest.mark.parametrize("name", sorted(Q.ORACLE_SQL))
def test_sql(spark, name):
    from pathlib import Path

    import duckdb

    c = duckdb.connect()
    for p in Path("/root/testdata/sf0.001").glob("*.parquet"):
        c.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM '{p}'")
    want = c.sql(Q.ORACLE_SQL[name])
    got = Q.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(got.columns) == sorted(want.columns)
    assert sorted(tuple(r[k] for k in want.columns) for r in got.collect()) == sorted(want.fetchall())


@pytest.fixture(scope="module")
def odd_ids(spark, tmp_path_factory):
    """Rows without an id, rows that repeat one with the same and with another text, and one of megabytes."""
    at = tmp_path_factory.mktemp("ids")
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet").select(["doc_id", "text"]).slice(0, 40).to_pylist()
    texts = [d["text"] for d in docs]
    docs += [{"doc_id": None, "text": t} for t in (texts[0], texts[0], texts[1] + " and more", None)]
    docs += [{"doc_id": 3, "text": texts[3]}, {"doc_id": 3, "text": texts[4]}, {"doc_id": 9000, "text": "a long text of many words " * 60_000 + "x" * 300_000}]
    spark.createDataFrame([(d["doc_id"], d["text"]) for d in docs], "doc_id long, text string").coalesce(1).write.parquet(f"{at}/documents.parquet")
    for name in ("benchmark", "labels"):
        spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet").write.parquet(f"{at}/{name}.parquet")
    return str(at), docs


@pytest.mark.parametrize("name", sorted(Q.QUERIES))
def test_null_and_repeated_ids(spark, odd_ids, name):
    at, docs = odd_ids
    rows = result(spark, name, at)
    if name == "op2_packing":
        rows = [r for r in rows if r["start"] == 0]
    assert sorted(str(r["doc_id"]) for r in rows) == sorted(str(d["doc_id"]) for d in docs)
    if name == "op9_jaccard":
        # rows are nodes, and the least id names them
        sets = [shingle_set(d["text"] or "", 3) for d in docs]
        comp = list(range(len(docs)))
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= 90 * len(a | b) and comp[i] != comp[j]:
                    comp = [comp[j] if c == comp[i] else c for c in comp]
        ids = {c: min((d["doc_id"] for d, x in zip(docs, comp) if x == c and d["doc_id"] is not None), default=None) for c in comp}
        want = sorted((str(d["doc_id"]), len(s), str(ids[c])) for d, s, c in zip(docs, sets, comp))
        assert sorted((str(r["doc_id"]), r["n_shingles"], str(r["component_id"])) for r in rows) == want


def luhn(digits):
    return sum(sum(divmod(2 * int(d), 10)) if i % 2 else int(d) for i, d in enumerate(reversed(digits))) % 10 == 0


def pii_base(text):
    out = [("email", m) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", m) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(x) <= 255 for x in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", m))
    out += [("phone", m) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.sub("[^0-9]", "", m[0])) <= 15]
    return [f"{k}:{m.start()}:{m.end()}" for k, m in out]


def test_op1(spark, hard_dir, texts):
    rows = result(spark, "op1_pii", hard_dir)
    assert len(rows) == len(texts)
    for r in rows:
        base = pii_base(texts[r["doc_id"]])
        assert r["base_sha256"] == sha(",".join(base)), (r, base)
        assert [r[f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(b.startswith(k) for b in base) for k in ("email", "ip", "card", "phone")]
        assert set(base) <= set(filter(None, r["spans"].split(",")))
    assert sum(r["n_email"] for r in rows) > 2


def test_op1_discovers_identifiers_behind_the_same_words(spark):
    from ledgerleaf.llm.pii import find

    docs = [(i, f"Please contact agent via mail to: user{i}@example.org today") for i in range(8)]
    docs += [(100, "Please contact agent via mail to: user7(at)example"), (101, "Write mail to: jane.doe99.example today"), (102, "plain build v1.2.33-abc here")]
    got = {r.doc_id: r for r in find(spark.createDataFrame(docs, "doc_id long, text string")).collect()}
    text = docs[9][1]
    assert [text[s.start : s.end] for s in got[101].email_all] == ["jane.doe99.example"] and not got[101].email
    assert not any(got[102][f"{k}_all"] for k in ("email", "ip", "card", "phone"))


def reference_ids(texts, name, end):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocabulary(name))
    return {d: np.array([*t.encode(x, add_special_tokens=False).ids, end], dtype="<u4") for d, x in texts.items()}


def test_encoder_on_odd_texts():
    import random

    import pyarrow as pa
    from tokenizers import Tokenizer

    from ledgerleaf.llm.tokens import TextEncoder

    rng = random.Random(5)
    signs = [*"aAbzZ  \n\n\t\r'.,!?-_<|>019éÉÿ÷×ñ½“”…\u00a0\u3000\x0b\x1c\x85日本🙂\u0301ßſ≠", "'s", "'ll", " The", "<|endoftext|>", "<|startoftext|>", ". ", "\r\n", " \n"]
    odd = ["".join(rng.choices(signs, k=rng.randrange(30))) for _ in range(8000)]
    odd.append("".join(rng.choices(["abc ", "Def, ", "\n", "x.y ", "é! ", "12 ", " \n "], k=1_000_000)))
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        plain, found = Tokenizer.from_file(vocabulary(name)), []
        for _, _, ids, edges in TextEncoder(vocabulary(name)).runs(pa.array([t.encode() for t in odd], pa.binary())):
            found += [ids[a:b] for a, b in zip(edges, edges[1:])]
        assert len(found) == len(odd) and all(np.array_equal(f, plain.encode(t, add_special_tokens=False).ids) for f, t in zip(found, odd))


def test_op2(spark, hard_dir, texts):
    want, sequences = reference_ids(texts, "word_bpe_49k.json", 1), {}
    seen = {d: np.zeros(len(w), dtype=int) for d, w in want.items()}
    for r in result(spark, "op2_packing", hard_dir):
        ids = want[r["doc_id"]]
        assert r["doc_tokens"] == len(ids)
        assert r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
        seen[r["doc_id"]][r["start"] : r["start"] + r["length"]] += 1
        sequences.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    assert all((s == 1).all() for s in seen.values())
    for pieces in sequences.values():
        at = 0
        for offset, length in sorted(pieces):
            assert offset == at and length > 0
            at += length
        assert at <= 2048
    assert len(sequences) * 2048 < 1.06 * sum(map(len, want.values())) + 4 * 2048


def test_op3(spark, hard_dir, texts):
    rows = {r["doc_id"]: r for r in result(spark, "op3_fingerprints", hard_dir)}
    order = sorted(texts)
    assert sorted(rows) == order
    prints = {}
    for d, after in zip(order, order[1:] + order[:1]):
        text, r = texts[d], rows[d]
        n = len(text) // 4
        edited = text[: len(text) - n] + texts[after][:n]
        assert r["n_chars"] == len(text) and r["edited_sha256"] == sha(edited)
        assert prints.setdefault(text, r["fingerprint"]) == r["fingerprint"]
        assert prints.setdefault(edited, r["edited_fingerprint"]) == r["edited_fingerprint"]
        assert 0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1
        assert (r["near_next"] == 1) >= (text == texts[after])
    assert len(set(prints.values())) == len(prints)
    far = [r for r in rows.values() if r["n_chars"] > 400]
    assert sum(r["near_edited"] > 0.5 for r in far) > 0.9 * len(far)


def secret_base(text):
    out = [(m.start(), 0, m) for m in re.finditer(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A) if len(m[2]) >= 12]
    out += [(m.start(), 1, m) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m[0]) >= 18]
    out += [(m.start(), 2, m) for m in re.finditer(r"[0-9a-f]+", text) if len(m[0]) >= 16]
    return [f"{('assign', 'access', 'hex')[k]}:{m.start()}:{m.end()}" for _, k, m in sorted(out, key=lambda x: x[:2])]


def test_op4(spark, hard_dir, texts):
    rows = result(spark, "op4_secrets", hard_dir)
    assert len(rows) == len(texts)
    for r in rows:
        base = secret_base(texts[r["doc_id"]])
        assert r["base_sha256"] == sha(",".join(base)) and set(base) <= set(filter(None, r["spans"].split(",")))
    novel = [texts[r["doc_id"]][int(s.split(":")[1]) : int(s.split(":")[2])] for r in rows for s in r["spans"].split(",") if s.startswith("novel")]
    assert "q8Zr2LmX0vKp7TnB4wYd" in novel and not any(s.startswith("configuration") for s in novel)


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text.translate({c: c + 32 for c in range(65, 91)}))


def leaks(text, windows):
    w = words(text)
    hit, items = set(), set()
    for n in {len(x) for x in windows}:
        for i in range(len(w) - n + 1):
            if found := windows.get(tuple(w[i : i + n])):
                hit.update(range(i, i + n))
                items |= found
    return len(w), len(hit), items


def benchmark_windows(sf_dir):
    windows = {}
    for r in pq.read_table(f"{sf_dir}/benchmark.parquet").to_pylist():
        w = words(r["text"] or "")
        for i in range(max(1, len(w) - 9)) if w else ():
            windows.setdefault(tuple(w[i : i + 10]), set()).add(r["item_id"])
    return windows


def test_op5(spark, hard_dir, texts):
    windows, rows = benchmark_windows(hard_dir), result(spark, "op5_decontamination", hard_dir)
    assert len(rows) == len(texts)
    for r in rows:
        n, hit, items = leaks(texts[r["doc_id"]], windows)
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(items))
        assert r["items_sha256"] == sha(",".join(sorted(map(str, items)))) and r["contaminated"] == (hit > 0)
    assert any(r["contaminated"] for r in rows)


def test_op5_in_blocks(spark, hard_dir, texts):
    from ledgerleaf.llm.decontamination import find, original_spans

    docs, bench = (spark.read.parquet(f"{hard_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    one, many = ({r.doc_id: r for r in find(docs, bench, block_bytes=b).collect()} for b in (1 << 24, 60_000))
    assert one == many
    text = "An Item: one, TWO. three"
    assert [text[a:b] for a, b in original_spans(text, [(2, 4)])] == ["one, TWO"]


def test_op7(spark, hard_dir, texts):
    rows = result(spark, "op7_quality", hard_dir)
    assert len(rows) == len(texts)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
        assert 0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3)


def test_op7_scores_are_those_of_the_compressors(spark, hard_dir, texts):
    """The registered scores from the model's dictionaries and weights, by plain compression of whole texts."""
    import zstandard

    from ledgerleaf.llm.quality import fit, score

    docs, labels = (spark.read.parquet(f"{hard_dir}/{t}.parquet") for t in ("documents", "labels"))
    model = fit(docs, labels, Q._remainder("doc_id", 5) != 0)
    sizes = []
    for raw in (model.good, model.bad):
        kind = zstandard.ZstdCompressionDict(raw)
        kind.precompute_compress(level=3)
        c = zstandard.ZstdCompressor(level=3, dict_data=kind, write_content_size=False, write_dict_id=False)
        sizes.append(lambda t, c=c: sum(len(c.compress(t[i : i + 2048])) for i in range(0, len(t), 2048)))
    for r in score(docs, model).collect():
        raw = texts[r.doc_id].encode()
        g, b, n = sizes[0](raw), sizes[1](raw), max(1, len(raw))
        z = model.weights[0] + sum(w * (v - m) / s for w, v, m, s in zip(model.weights[1:], ((b - g) / n, (n - g) / n), model.means, model.scales))
        assert r.score == pytest.approx(1 / (1 + np.exp(-z)), abs=1e-12)
    # a long labelled text takes part by stretches of it
    import random

    rng = random.Random(8)
    words = [["".join(rng.choices("abcdefghijkl", k=6)) for _ in range(400)] for _ in range(2)]
    rows = [(i, " ".join(rng.choices(words[i % 2], k=9000 if i < 10 else 150)), i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    m = fit(df, df.select("doc_id", "quality"), F.lit(True), longest=1 << 13)
    assert all((r.score > 0.5) == bool(r.doc_id % 2) for r in score(df, m).collect())


def test_op7_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.1"
    label = {r["doc_id"]: r["quality"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    rows = [r for r in result(spark, "op7_quality", sf) if r["held_out"] and r["doc_id"] in label]
    right = [r["predicted"] == label[r["doc_id"]] for r in rows]
    kept = [r["predicted"] for r in rows if label[r["doc_id"]] == 1]
    assert sum(right) > 0.95 * len(right) and sum(kept) > 0.98 * len(kept)


def test_op8(spark, hard_dir, texts):
    want, start = reference_ids(texts, "byte_bpe_50k.json", 2), 0
    rows = {r["doc_id"]: r for r in result(spark, "op8_token_files", hard_dir)}
    for d in sorted(texts):
        assert rows[d] == {"doc_id": d, "start": start, "n_tokens": len(want[d]), "ids_crc32": zlib.crc32(want[d].tobytes())}
        start += len(want[d])


def test_op8_segments_and_checkpoints():
    from ledgerleaf.llm import tokenfiles as t

    rng = np.random.default_rng(3)
    for n in (1, 63, 64, 5000, 1_300_000):
        ids = np.minimum(rng.zipf(1.3, n), 50_256).astype(np.uint16)
        docs, lengths, back = t.decode_segment(t.encode_segment([7, None], [ids[: n // 2], ids[n // 2 :]]))
        assert docs == [7, None] and lengths == [n // 2, n - n // 2] and (back == ids).all()
    table = t.Table.of(ids)
    block = bytearray(t.encode_block(ids[: t.BLOCK], table))
    assert len(block) < 1.1 * t.BLOCK
    block[len(block) // 2] ^= 1
    with pytest.raises((ValueError, IndexError)):
        t.decode_block(memoryview(bytes(block)), table, table.by_slot())


def test_op10(spark, hard_dir, texts):
    rows = result(spark, "op10_sharding", hard_dir)
    assert len(rows) == len(texts)
    shards = {}
    for r in rows:
        raw = texts[r["doc_id"]].encode()
        assert r["size"] == len(raw) + 8 and r["text_crc32"] == zlib.crc32(raw) and r["law"] == "bytes" and r["grown_shard"] is None
        shards.setdefault(r["shard"], []).append((r["slot"], r["size"]))
    assert set(shards) <= set(range(24))
    for s in shards.values():
        assert [x for x, _ in sorted(s)] == list(range(len(s)))


def test_op10_sizes_are_near_equal(spark):
    rows = result(spark, "op10_sharding", "/root/testdata/sf0.1")
    sizes = [sum(r["size"] for r in rows if r["shard"] == k) for k in range(24)]
    most = max(r["size"] for r in rows)
    assert max(sizes) - min(sizes) <= 2 * most


def shingle_set(text, width):
    w = re.split(r"[\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)}))
    w = [x for x in w if x]
    return {tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))} if w else set()


def brute_components(texts, width, num):
    sets = {d: shingle_set(t, width) for d, t in texts.items()}
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    order = sorted((len(s), d) for d, s in sets.items() if s)
    for i, (n, a) in enumerate(order):
        for m, b in order[i + 1 :]:
            if n * 100 < num * m:
                break
            shared = len(sets[a] & sets[b])
            if 100 * shared >= num * (n + m - shared):
                x, y = sorted((root(a), root(b)))
                parent[y] = x
    return {d: (len(s), root(d)) for d, s in sets.items()}


def test_op9(spark, hard_dir, texts):
    want = brute_components(texts, 3, 90)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in result(spark, "op9_jaccard", hard_dir)}
    assert got == want
    assert len({c for _, c in want.values()}) < len(want) - 5


def test_op9_chains_and_large_cells(spark, monkeypatch):
    import random

    from ledgerleaf.llm import jaccard

    rng = random.Random(4)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts, serial = {}, 0
    for family in range(6):
        base = [rng.choice(vocabulary) for _ in range(rng.choice((12, 60, 200)))]
        for step in range(40 if family else 150):
            edited = list(base)
            for _ in range(rng.choice((0, 1, 1, 2))):
                edited[rng.randrange(len(edited))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                base = edited
            texts[serial] = " ".join(edited)
            serial += 1
    common = " ".join(rng.choice(vocabulary) for _ in range(30))
    for _ in range(150):
        texts[serial] = common + " " + " ".join(rng.choice(vocabulary) for _ in range(40))
        serial += 1
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    monkeypatch.setattr(jaccard, "BLOCK", 16)
    monkeypatch.setattr(jaccard, "BROADCAST_ROWS", 10)
    for width, num in ((3, 90), (5, 80)):
        want = brute_components(texts, width, num)
        got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_components(docs, width, num).collect()}
        assert got == want


def test_op9_a_dense_group_does_not_become_all_its_pairs(spark, monkeypatch):
    import random

    from ledgerleaf.llm import jaccard

    rng, pairs = random.Random(9), []
    base = [f"w{i}" for i in range(150)]
    texts = {}
    for serial in range(400):
        edited = list(base)
        for at in rng.sample(range(5, 145, 10), 3):
            edited[at] = f"x{at}-{rng.randrange(3)}"
        texts[serial] = " ".join(edited)
    whole = jaccard.bundled

    def counted(rows):
        pairs.append(rows.count())
        return whole(rows)

    monkeypatch.setattr(jaccard, "bundled", counted)
    docs = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in jaccard.linked_components(docs, 3, 90).collect()}
    assert got == brute_components(texts, 3, 90)
    assert max(pairs) <= 3 * len(texts), pairs


def test_op6(spark, hard_dir, texts):
    import math
    from collections import Counter

    def tokens(text):
        return [x for x in re.split(r"[\x20\x09-\x0D]+", text.translate({c: c + 32 for c in range(65, 91)})) if x] + [None]

    held = {d: zlib.crc32(str(d).encode()) % 10 == 0 for d in texts}
    c = Counter(t for d, x in texts.items() if not held[d] for t in tokens(x))
    n, v = sum(c.values()), len(c)
    rows = result(spark, "op6_language_model", hard_dir)
    assert len(rows) == len(texts)
    for r in rows:
        t = tokens(texts[r["doc_id"]])
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[r["doc_id"]], len(t), sum(c[x] > 0 for x in t), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 0.1) / (n + 0.1 * (v + 1))) for x in t), rel=1e-9)
        assert math.isfinite(r["score"]) and r["score"] <= 0


def test_op6_prefers_words_and_spellings_it_has_learned(spark):
    from ledgerleaf.llm.lm import score

    import random

    rng, rows = random.Random(2), []
    docs = pq.read_table("/root/testdata/sf0.01/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    for r in docs[:400]:
        rows.append((r["doc_id"], r["text"]))
        if r["doc_id"] % 10 == 0:
            rows.append((10_000 + r["doc_id"], " ".join("".join(rng.sample(w, len(w))) for w in r["text"].split())))
            rows.append((20_000 + r["doc_id"], " ".join(rng.sample(r["text"].split(), len(r["text"].split())))))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r.score for r in score(df, F.col("doc_id") % 10 == 0).collect()}
    plain = [d for d in got if d < 10_000 and d % 10 == 0]
    assert all(got[d] > got[10_000 + d] for d in plain if len(docs[d]["text"]) > 200)
    assert all(got[d] == pytest.approx(got[20_000 + d]) for d in plain)
    # rarer words than fit into the filter are left to their spellings; nothing is dropped
    small = {r.doc_id: r.score for r in score(df, F.col("doc_id") % 10 == 0, most_bits=1 << 20).collect()}
    assert small.keys() == got.keys() and sum(small[d] > small[10_000 + d] for d in plain) > 0.9 * len(plain)


def test_op6_filter_reads_counts_back(spark):
    from ledgerleaf.llm import lm

    rng = np.random.default_rng(1)
    keys = rng.integers(0, 1 << 63, 5000).astype(np.int64)
    counts = np.minimum(rng.zipf(1.5, 5000), 10**8)
    df = spark.createDataFrame([(int(k), int(c)) for k, c in zip(keys, counts)], "key long, c long")
    entries = df.select("key", lm.level_of(df.c).alias("level")).selectExpr("key", "level", "1 as first")
    total = entries.agg({"level": "sum"}).first()[0]
    f = lm.LogFilter(lm.filter_pages(entries, max(1, lm.PER_ENTRY * total // lm.PAGE)), 1)
    ratio = f.count(keys.view(np.uint64)) / counts
    assert ((ratio > 0.7) & (ratio < 1.5)).mean() > 0.97 and (f.count(keys.view(np.uint64)) > 0).all()
    assert (f.count(rng.integers(0, 1 << 63, 5000).astype(np.uint64)) > 0).mean() < 0.03


def test_op6_probabilities_sum_to_one_over_spellings(spark):
    from ledgerleaf.llm import lm

    words = [b"ab", b"aba", b"ba", b"b", b"aab"]
    df = spark.createDataFrame([(w, 50 + 10 * i) for i, w in enumerate(words)], "word binary, n long")
    grams = lm.byte_grams(df)
    entries = grams.select("key", lm.level_of(grams.n).alias("level")).selectExpr("key", "level", "1 as first")
    s = lm.Scorer(lm.filter_pages(entries, 16), 1, 1, 1.0)
    s.filter_bytes = df.selectExpr("sum((length(word) + 1) * n)").first()[0]
    every = [bytes(x) for n in range(1, 8) for x in __import__("itertools").product(b"ab", repeat=n)]
    assert 0.6 < (10 ** s.spelled(every)).sum() < 1.4


def test_op6_filter_grows_in_ranges_and_leaves_no_word_out(spark):
    from ledgerleaf.llm.lm import score

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    whole, ranges = ({r.doc_id: r.score for r in score(docs, F.col("doc_id") % 10 == 0, most_bits=bits).collect()} for bits in (1 << 28, 1 << 15))
    # one page a range: as many ranges as pages, and the same counts
    assert whole.keys() == ranges.keys() and all(ranges[d] == pytest.approx(s, rel=1e-12) for d, s in whole.items())


def test_op6_word_contexts_against_exact_counts(spark):
    import math
    from collections import Counter

    from ledgerleaf.llm.lm import score

    train = ["a b c d", "a b c e", "b c d", "x a b"]
    held = ["a b c d", "d c b a", "q a b", "", "a", "b", "c", "d", "q"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(train)] + [(100 + i, t) for i, t in enumerate(held)], "doc_id long, text string")
    one, three = ({r.doc_id: r.score for r in score(df, F.col("doc_id") >= 100, word_orders=k).collect()} for k in (1, 3))
    of_word = {w: one[100 + i] - (one[103] if w else 0) for i, w in enumerate(held) if len(w) < 2}

    c = Counter()
    for t in train:
        w = ["", *t.split(), ""]
        c.update((x,) for x in w[1:])
        c.update(tuple(w[i : i + k]) for k in (2, 3) for i in range(len(w) - k + 1))
    exact = lambda n: 4.5 if n in (4, 5) else n  # noqa: E731  what a level stands for
    for i, t in enumerate(held):
        w, total = ["", *t.split(), ""], 0
        for j in range(1, len(w)):
            p, n = 10 ** of_word[w[j]], c[(w[j - 1],)]
            for k in range(2, min(3, j + 1) + 1):
                gram = exact(c[tuple(w[j - k + 1 : j + 1])])
                n = max(n, gram) if k == 2 else max(exact(c[tuple(w[j - k + 1 : j])]), gram)
                p = (gram + 2 * max(n, 1) ** 0.5 * p) / (n + 2 * max(n, 1) ** 0.5)
            total += math.log10(p)
        assert three[100 + i] == pytest.approx(total, rel=1e-6), t


def test_op6_query_hears_the_order_of_words(spark, tmp_path):
    import random

    rng, rows = random.Random(3), []
    docs = pq.read_table("/root/testdata/sf0.001/documents.parquet", columns=["doc_id", "text"]).to_pylist()
    for r in docs:
        words = r["text"].split()
        rows += [r, {"doc_id": r["doc_id"] + 100_000, "text": " ".join(rng.sample(words, len(words)))}]
    spark.createDataFrame([(r["doc_id"], r["text"]) for r in rows], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["score"] for r in result(spark, "op6_language_model", str(tmp_path))}
    long = [r["doc_id"] for r in docs if len(r["text"].split()) > 20]
    assert any(got[d] != pytest.approx(got[d + 100_000]) for d in long)


def test_op10_a_cut_tears_one_group_of_equal_texts(spark):
    from ledgerleaf.llm.sharding import histogram_sort

    many = spark.range(80_000).selectExpr("id as doc_id", "concat('text ', id % 40000) as text")
    docs = many.union(spark.range(100_000, 140_000).selectExpr("id", "'the same'"))
    rows = histogram_sort(docs).cache()
    torn = rows.groupBy("text").agg(F.countDistinct("shard").alias("k")).where("k > 1").count()
    assert torn <= 23
    by_shard = rows.groupBy("shard").agg(F.count("*").alias("n"), F.countDistinct("slot").alias("slots"), F.max("slot").alias("last"), F.sum("size").alias("size")).collect()
    assert len(by_shard) == 24 and all(r.n == r.slots == r.last + 1 for r in by_shard)
    assert max(r.size for r in by_shard) - min(r.size for r in by_shard) <= 0.01 * sum(r.size for r in by_shard) / 24
    # equal texts stand side by side
    runs = {(r.shard, r.text): (r.a, r.b, r.n) for r in rows.groupBy("shard", "text").agg(F.min("slot").alias("a"), F.max("slot").alias("b"), F.count("*").alias("n")).collect()}
    assert all(b - a + 1 == n for a, b, n in runs.values())


def test_op3_borders_follow_the_content(spark):
    import random

    from ledgerleaf.llm.fingerprints import differing, differing_lines, fingerprints, likeness

    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgh", k=rng.randrange(2, 9))) for _ in range(900)]
    line = " ".join(rng.choices(words, k=400))
    lines = "\n".join(" ".join(rng.choices(words, k=9)) for _ in range(300)).split("\n")
    edit = [*lines[:100], "a new line of words", *lines[100:200], lines[200] + " changed", *lines[201:]]
    texts = [line, "x " + line, "\n".join(lines), "\n".join(edit), " ".join(rng.choices(words, k=400)), "word " * 3000, "other " * 3000, "word " * 2999]
    trees = fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    both = trees.select(*[F.col(c).alias(f"a_{c}") for c in trees.columns]).crossJoin(trees.select(*[F.col(c).alias(f"b_{c}") for c in trees.columns]))
    rows = both.select("a_doc_id", "b_doc_id", likeness("a_", "b_").alias("near"), differing_lines("a_", "b_").alias("lines"), F.size(differing("a_", "b_")).alias("sections"), F.size("a_sections").alias("of")).collect()
    got = {(r.a_doc_id, r.b_doc_id): r for r in rows}
    assert got[0, 1].near > 0.9 and got[2, 3].near > 0.98 and got[0, 4].near < 0.05 and got[5, 6].near == 0
    assert got[3, 2].lines == [100, 201] and got[2, 3].lines == [200] and 0 < got[3, 2].sections < 0.1 * got[3, 2].of
    assert all((r.near == 1) == (a == b) and r.near == got[b, a].near for (a, b), r in got.items())


def test_op4_takes_whole_candidates():
    import random
    import string

    from ledgerleaf.llm.secrets import Novelty, base_spans, novel_spans

    rng = random.Random(1)
    for n in (24, 700, 1500, 40_000):
        for lead in ("the private key below ", "my token ", "secrettoken "):
            candidate = "".join(rng.choices(string.ascii_letters + string.digits, k=n))
            text = "Here is " + lead + candidate + " and more words"
            at = text.index(candidate)
            assert novel_spans(text, base_spans(text), Novelty(), 48, 0.6) == [("novel", at, at + n)], (n, lead)
    # the tail of a run that a sensitive word belongs to is none
    text = "seetoken" + "".join(rng.choices(string.ascii_letters + string.digits, k=40))
    assert novel_spans(text, [], Novelty(), 48, 0.6) == []


def test_op1_kinds_of_candidates_and_patterns_of_discovered_strings(spark):
    from ledgerleaf.llm.pii import find

    docs = [(i, f"Please call the office phone: +49 170 12345{i:02d} now") for i in range(8)]
    docs += [(20 + i, f"Phone: +1 234 567 89{i:02d}, thanks") for i in range(8)]
    docs += [(40 + i, f"write your mail to: user{i}@example.org today") for i in range(8)]
    long = "x7." * 30 + "end9"
    docs += [(100, "Please call the office phone: 030 1234 567 now"), (101, "Phone: (555) 123 4567, thanks"), (102, "write your mail to: admin@localhost today"), (103, f"write your mail to: {long} today")]
    # found behind a seeds' pattern, these strings make a pattern of their own, behind which one more is found
    docs += [(200 + i, f"write your mail to: name{i}.example today") for i in range(4)]
    docs += [(300 + i, f"cc goes with {'name' + str(i) if i < 4 else 'other7'}.example too") for i in range(5)]
    docs += [(400, "plain build v1.2.33-abc here"), (401, "")]
    got = {r.doc_id: r for r in find(spark.createDataFrame(docs, "doc_id long, text string"), confidence=0.5).collect()}
    text = dict(docs)
    found = lambda d, k: [text[d][s.start : s.end] for s in got[d][f"{k}_all"]]
    assert found(100, "phone") == ["030 1234 567"] and found(101, "phone") == ["(555) 123 4567"]
    assert found(102, "email") == ["admin@localhost"] and found(103, "email") == [long]
    assert found(304, "email") == ["other7.example"]
    assert not any(got[d][f"{k}_all"] for d in (400, 401) for k in ("email", "ip", "card", "phone"))


def test_components_take_no_rounds_for_stars_and_few_for_paths(spark, monkeypatch):
    import random

    from ledgerleaf.llm import graphs

    written, whole = [], graphs.stored

    def counted(df, label):
        written.append(label)
        return whole(df, label)

    monkeypatch.setattr(graphs, "stored", counted)
    rng = random.Random(4)
    stars = [(c, c + i) for c in range(0, 300, 30) for i in range(1, 9)]
    path = [(1000 + i, 1001 + i) for i in range(40)]
    mixed = [(2000 + rng.randrange(80), 2000 + rng.randrange(80)) for _ in range(60)]
    for links, most in ((stars + stars[:5], 0), ([], 0), (stars + path + mixed, 6)):
        least = {n: n for pair in links if pair[0] != pair[1] for n in pair}
        for _ in range(len(least)):
            for a, b in links:
                if a != b:
                    least[a] = least[b] = min(least[a], least[b])
        for few in (graphs.FEW, 0):
            monkeypatch.setattr(graphs, "FEW", few)
            written.clear()
            got = graphs.components(spark.createDataFrame(links, "a long, b long")).collect()
            assert {r.node: r.component for r in got} == least and len(got) == len(least), few
            assert len(written) <= most, written
