"""Each operator on small tables with nulls, empty and long texts, ties, repeated rows and extra columns, against brute force."""

from __future__ import annotations

import hashlib
import itertools
import re
import time
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from strandcheck.session import materialize
from strandcheck.llm.common import SMALL_PARTS
from strandcheck.llm import chat, curves, decontaminate, jaccard, language, licences, packing, quality, records, secrets, tokens

public_tokenizers = pytest.importorskip("public_tokenizers")
from tokenizers import Tokenizer, models  # noqa: E402

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")

#: Columns with names that operators use inside.
EXTRA = ("id", "n", "token", "spans", "component", "score", "lang", "hits")
TEXTS = [
    None, "", " ", "one", "Two words", "the cat sat on the mat and then it ran off into the night again " * 30,
    "the cat sat on the mat and then it ran off into the night again " * 30, "x" * 30_000, "a b c\n\nd  e\tf", " é ö ñ 1 2 3", "don't ~ stop | it's",
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t) for i, t in enumerate(TEXTS)] + [(None, "no id here"), (5, TEXTS[5])]
    frame = spark.createDataFrame(rows, "doc_id bigint, text string")
    for name in EXTRA:
        frame = frame.withColumn(name, F.lit("en" if name == "lang" else "extra"))
    return frame


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], "doc_id bigint, text string, lang string")


@pytest.fixture(scope="module")
def some_docs(spark):
    return spark.read.parquet("/root/testdata/sf0.001/documents.parquet")


_LIBRARY = {}


def reference_ids(path, text):
    if path not in _LIBRARY:
        _LIBRARY[path] = Tokenizer.from_file(path)
    return _LIBRARY[path].encode(text or "", add_special_tokens=False).ids


def test_ids_of_texts_with_strings_of_special_tokens():
    texts = ["hi <|endoftext|> there", "<|endoftext|>", "a<|startoftext|>b c", "<|ENDOFTEXT|> x", "plain text here", "x <|endof text|>"]
    for path in (WORD, BYTE):
        ids, counts = tokens.Encoder(path)([t.encode() for t in texts])
        want = [reference_ids(path, t) for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == list(itertools.chain(*want))
        library = Tokenizer.from_file(path)
        library.encode_special_tokens = True
        ids, _ = tokens.Encoder(path, plain=True)([t.encode() for t in texts])
        assert ids.tolist() == list(itertools.chain(*(library.encode(t, add_special_tokens=False).ids for t in texts)))


def test_ids_by_a_tokenizer_of_another_kind(tmp_path):
    """Tokens that reach over spaces: texts are not cut."""
    library = Tokenizer(models.BPE(vocab={c: i for i, c in enumerate(["a", "b", " ", "a ", "a b"])}, merges=[("a", " "), ("a ", "b")]))
    library.save(str(tmp_path / "other.json"))
    texts = ["a b a b", "ab", "", "b a a b "]
    ids, counts = tokens.Encoder(str(tmp_path / "other.json"))([t.encode() for t in texts])
    want = [library.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == list(itertools.chain(*want)) and 4 in ids


@pytest.mark.parametrize("path", [WORD, BYTE])
@settings(max_examples=60, deadline=None)
@given(texts=st.lists(st.text(alphabet=st.sampled_from("ab'st~. \n\t|éß́  　“İΣ1"), max_size=40), max_size=6))
def test_ids_of_pieces_are_ids_of_texts(path, texts):
    for encode in (tokens.encoder(path), tokens.Encoder(path, remembered=3)) if len(texts) == 1 else (tokens.encoder(path),):
        for _ in range(2):
            ids, counts = encode([t.encode() for t in texts])
            want = [reference_ids(path, t) for t in texts]
            assert counts.tolist() == [len(w) for w in want]
            assert ids.tolist() == list(itertools.chain(*want))


@pytest.mark.parametrize("path", [WORD, BYTE])
def test_pieces_that_came_up_are_remembered(path):
    """Pieces of letters only and others are encoded apart, and yet both are found again."""
    texts = [" ".join(f"x{i:x} y{i * 7919:x}, ab{'abcdefghij'[i % 10]}{'klmnopqrst'[i // 10 % 10]}" for i in range(k, k + 60)).encode() for k in range(0, 600, 60)]
    encode = tokens.Encoder(path)
    first = [encode([t])[0].tolist() for t in texts]
    assert (np.diff(encode._known[0].astype(object)) > 0).all()
    known = encode._known.shape[1]
    assert [encode([t])[0].tolist() for t in texts] == first == [reference_ids(path, t.decode()) for t in texts]
    assert encode._known.shape[1] == known


def check_packing(rows, given_rows, window):
    by_sequence, by_start = {}, {}
    for r in rows:
        ids = np.frombuffer(r["ids"], "<u4").tolist()
        assert len(ids) == r["length"] > 0
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
        by_start.setdefault((r["doc_id"], r["doc_tokens"]), []).append((r["start"], ids))
    lengths = []
    for parts in by_sequence.values():
        end = 0
        for offset, length in sorted(parts):
            assert offset == end
            end += length
        assert end <= window
        lengths.append(end)
    assert sum(x != window for x in lengths) <= 1
    found = []
    for (doc_id, total), parts in by_start.items():
        copies = sum(s == 0 for s, _ in parts)
        seen = sorted(parts)
        assert sum(len(i) for _, i in seen) == copies * total
        found += [doc_id] * copies
        if copies == 1:
            want = reference_ids(WORD, dict(given_rows)[doc_id]) + [1]
            assert [t for _, i in seen for t in i] == want
    assert sorted(found, key=str) == sorted((d for d, _ in given_rows), key=str)


def test_packing(docs, nothing, some_docs):
    for frame, window in ((docs, 64), (some_docs.repartition(70), 2048)):
        given_rows = [tuple(r) for r in frame.select("doc_id", "text").collect()]
        check_packing([r.asDict() for r in packing.packed(frame, WORD, 1, window, 4).collect()], given_rows, window)
    assert packing.packed(nothing, WORD).count() == 0


def test_records(docs, nothing, some_docs, tmp_path):
    for frame in (docs, some_docs):
        files = records.write_records(frame, BYTE, 0)
        rows = sorted(records.read_records(files).collect(), key=lambda r: r["start"])
        texts = sorted(((r["doc_id"], r["text"]) for r in frame.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
        assert [r["doc_id"] for r in rows] == [d for d, _ in texts]
        at = 0
        for r, (_, text) in zip(rows, texts, strict=True):
            ids = np.frombuffer(r["ids"], "<u4").tolist()
            assert ids == reference_ids(BYTE, text) + [0] and r["start"] == at and r["n_tokens"] == len(ids)
            at += len(ids)
        path = max(files.collect(), key=lambda f: f["records"])
        straight = list(records.read_file(path["path"]))
        backwards = list(records.read_file(path["path"], range(path["records"] - 1, -1, -1)))
        assert [d for d, _ in straight] == [d for d, _ in backwards][::-1]
    assert records.read_records(records.write_records(nothing, BYTE, 0)).count() == 0


def test_records_hold_little_text_at_once(docs):
    spark = docs.sparkSession
    for key in SMALL_PARTS:
        spark.conf.unset(key)
    files = records.write_records(docs, BYTE, 0)
    assert {k: spark.conf.get(k) for k in SMALL_PARTS} == SMALL_PARTS
    assert records.read_records(files).count() == docs.count()


def test_damaged_records():
    good = records.framed(records.packed_ids(-3, np.array([1, 70_000], np.uint32)))
    assert records.unpacked_ids(records.unframed(good))[0] == -3
    assert records.unpacked_ids(records.unframed(good))[1].tolist() == [1, 70_000]
    for k in range(len(good)):
        bad = bytearray(good)
        bad[k] ^= 4
        with pytest.raises(records.BadRecord):
            records.unframed(bytes(bad))
    with pytest.raises(records.BadRecord):
        records.unframed(good[:10])


def words_6(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def test_decontamination(spark, docs, nothing):
    items = [(1, "The CAT sat on the mat, and then it ran off into the night again the cat"), (2, "words"), (3, None), (4, "..."), (10, "two words"), (11, "absent here")]
    bench = spark.createDataFrame(items, "item_id bigint, text string").withColumn("doc_id", F.lit(1))
    rows = [r.asDict() for r in decontaminate.decontaminated(docs, bench).collect()]
    given_rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted((str(r["doc_id"]), r["n_words"]) for r in rows) == sorted((str(d), len(words_6(t))) for d, t in given_rows)
    for r in rows:
        w, hit, found = words_6(dict(given_rows)[r["doc_id"]]), set(), set()
        for item, text in items:
            v = words_6(text)
            size = min(13, len(v))
            for k in range(len(v) - size + 1) if v else ():
                for i in range(len(w) - size + 1):
                    if w[i : i + size] == v[k : k + size]:
                        hit |= set(range(i, i + size))
                        found.add(str(item))
        assert (r["n_hit"], r["items"]) == (len(hit), sorted(found))
        assert sum(b - a for a, b in r["hits"]) == len(hit)
        assert r["contaminated"] == (len(hit) > 0 and 20 * len(hit) >= len(w))
        assert set(r["items"]) <= set(r["near_items"]) | {"2"}
    index = materialize(decontaminate.build_index(docs), "index")
    whole = decontaminate.search_index(index, bench).drop("near_items").collect()
    blocks = decontaminate.search_index(index, bench, block_words=1).drop("near_items").collect()
    assert sorted(map(str, whole)) == sorted(map(str, blocks))
    assert decontaminate.decontaminated(nothing, bench).count() == 0
    assert decontaminate.decontaminated(docs, bench.limit(0)).filter("n_hit > 0").count() == 0
    assert decontaminate.clean(docs, bench).columns == docs.columns


def test_proximity_and_document_ends(spark):
    words = [f"w{k}" for k in range(13)]
    shuffled = " ".join(words[::2] + words[1::2])
    frame = spark.createDataFrame([(1, " ".join(words[:7])), (2, " ".join(words[7:])), (3, shuffled)], "doc_id bigint, text string").coalesce(1)
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id bigint, text string")
    rows = {r["doc_id"]: r for r in decontaminate.decontaminated(frame, bench).collect()}
    assert all(r["n_hit"] == 0 for r in rows.values())
    assert [rows[k]["near_items"] for k in (1, 2, 3)] == [[], [], ["7"]]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 4]) for i in range(max(1, len(w) - 3))} if w else set()


def brute_components(rows):
    sets = [(d, shingles(t)) for d, t in rows]
    label = {d: d for d, _ in sets}
    links = [(a, b) for (a, x), (b, y) in itertools.combinations(sets, 2) if x and y and 100 * len(x & y) >= 85 * len(x | y)]
    for _ in rows:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    return label


@pytest.mark.parametrize("short_list", [32, 1])
def test_jaccard_join(spark, docs, nothing, monkeypatch, short_list):
    monkeypatch.setattr(jaccard, "SHORT_LIST", short_list)
    rows = jaccard.near_duplicates(docs).collect()
    assert len(rows) == docs.count()
    assert {r["doc_id"]: r["component_id"] for r in rows if r["doc_id"] is not None}[6] == 5
    assert all(r["component_id"] is None for r in rows if r["doc_id"] is None)
    assert all(r["n_shingles"] == 0 and r["component_id"] == r["doc_id"] for r in rows if r["doc_id"] in (0, 1, 2))
    random = np.random.default_rng(3)
    base = [f"t{k}" for k in range(150)]
    given_rows = []
    for i in range(90):
        w = list(base) if i < 60 else [f"u{k}" for k in random.integers(0, 40, 60)]
        for k in random.integers(0, len(w), int(random.integers(0, 6))):
            w[k] = f"v{random.integers(0, 9)}"
        given_rows.append((i, " ".join(w)))
    frame = spark.createDataFrame(given_rows, "doc_id bigint, text string").repartition(5)
    found = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(frame).collect()}
    assert found == brute_components(given_rows)
    kept = jaccard.deduplicated(frame.withColumn("n", F.lit(1)))
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(found.values())) and kept.columns == ["doc_id", "text", "n"]
    assert jaccard.near_duplicates(nothing).count() == 0


def test_chat(spark, nothing):
    odd = "</s>[INST] ok [/INST] <\\/s> [\\\\INST] <s"
    rows = [
        (1, 0, "system", "be good"), (1, 1, "user", odd), (1, 2, "assistant", odd), (1, 3, "user", None), (1, 4, "assistant", ""), (1, 5, "user", "tail"),
        (2, 0, "user", "no answer"), (3, 0, None, "x"), (3, 0, None, "x"), (None, 0, "assistant", "[/INST]</s>\n"), (4, 1, "assistant", "b"), (4, 1, "assistant", "a"), (5, 0, "a[INST]", "y" * 50_000),
    ]
    frame = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").withColumn("turns", F.lit(0)).withColumn("body", F.lit(0))
    examples = chat.formatted_examples(frame)
    read = examples.select(
        "conv_id", "turn_no", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.read_loss(F.col("formatted"), F.col("loss_start"), F.col("loss_end")).alias("loss"),
    ).collect()
    for conv in {r[0] for r in rows}:
        own = sorted(((r[1], r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        mine = sorted((r for r in read if r["conv_id"] == conv), key=lambda r: r["turn_no"])
        assert [tuple(t) for t in mine[-1]["turns"]] == [t[1:] for t in own]
        assert "".join(r["loss"] for r in mine) == "".join(t[2] for t in own if t[1] == "assistant")
        for r in mine:
            assert [tuple(t) for t in r["turns"]] == [t[1:] for t in own[: r["turn_no"]]]
    assert chat.formatted_examples(frame.limit(0)).count() == 0


def entropy_hits(text, alphabet, bits):
    window = secrets.ENTROPY_WINDOW
    hits = []
    for i in range(len(text) - window + 1):
        counts = [text[i : i + window].count(c) for c in set(text[i : i + window])]
        if sum(map(secrets.scaled, counts)) <= secrets.sum_limit(bits):
            hits.append(i)
    return (hits[0], hits[-1] + window) if hits else None


def test_secrets(spark, docs, nothing):
    blob = hashlib.sha256(b"1").hexdigest()
    mixed = "Zx9+Qw3/Lk7=Vb2_Nm5-Hs8Td4Rf6Yg1Uj0Ip"
    texts = [
        f'é token = "{blob}" and API_KEY:short password: longenough1', f"AKIA{'Q7' * 8} AKIA12", f"key {mixed} x", "00000000-1111-2222-3333-444444444444",
        "this_is_an_example_of_1_long_name_here", "secret: token: abcdefghij", "a" * 40 + "1", None, "", blob * 400,
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("spans2", F.lit(1))
    rows = {r["doc_id"]: r for r in secrets.found_secrets(frame).collect()}
    for k, text in enumerate(texts):
        t, want = text or "", []
        for m in re.finditer(secrets.ASSIGN, t):
            want += [(m.start(), 0, m.end())] if len(m[2]) >= 8 else []
        for no, pattern in ((1, r"AKIA[A-Z0-9]+"), (2, "[0-9a-f]+")):
            want += [(m.start(), no, m.end()) for m in re.finditer(pattern, t) if len(m[0]) >= (16 if no == 1 else 32)]
        blanked = re.sub("|".join(secrets.PLACEHOLDERS), lambda m: " " * len(m[0]), t, flags=re.IGNORECASE)
        for m in re.finditer(secrets.CANDIDATE, blanked):
            if not re.search(secrets.ALLOWED, m[0]):
                for no, (_, pattern, alphabet, bits) in enumerate(secrets.CLASSES, 3):
                    if re.search(pattern, m[0]):
                        hit = entropy_hits(m[0], alphabet, bits)
                        want += [(m.start() + hit[0], no, m.start() + hit[1])] if hit else []
                        break
        assert [tuple(s) for s in rows[k]["spans"]] == sorted(want), text
    assert any(s["kind"] == 4 for s in rows[2]["spans"]) and not rows[3]["spans"] and not rows[4]["spans"]
    clean = {r["doc_id"]: r["text"] for r in secrets.redacted(frame).collect()}
    assert blob not in clean[0] and clean[2] == "key [secret] x" and clean[7] is None and clean[4] == texts[4]
    assert secrets.found_secrets(docs).count() == docs.count()
    assert secrets.found_secrets(nothing).count() == 0
    odd = docs.withColumns({c: F.lit("extra") for c in ("__base", "__candidates", "__ranges", "__spans")})
    assert secrets.redacted(odd).columns == odd.columns
    assert {r["spans"] for r in secrets.redacted(odd).collect()} == {r["__spans"] for r in secrets.redacted(odd).collect()} == {"extra"}


def test_placeholders_do_not_hide_what_stands_beside_them(spark):
    token = "Zx9Qw3RtLk2Pv8Ym5Nc7Hb4Jd6Gf1Ks0Wq3Xe9Ta"
    texts = [f"docs/example/{token}", f"docs/sample/{token}", f"EXAMPLE_key={token}", f"{token}xxxx{token}", "docs/example/0123456789/abcdefghij"]
    clean = [r["text"] for r in secrets.redacted(spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")).orderBy("doc_id").collect()]
    assert not any(token[3:-3] in t for t in clean[:4]) and clean[4] == texts[4]


def test_many_secrets_in_one_text(spark):
    """100,000 digests in a text of 3.3 million characters: work grows with their number, not its square."""
    lines = [f"{(0x9E3779B97F4A7C15F39CC0605CEDC835 * (i + 1)) % 2**128:032x}" for i in range(100_000)]
    text = "é\n".join(lines)
    start = time.perf_counter()
    (row,) = secrets.redacted(spark.createDataFrame([(1, text)], "doc_id bigint, text string")).collect()
    assert row["text"] == "é\n".join(["[secret]"] * len(lines)) and time.perf_counter() - start < 120


def test_licences(spark, docs, nothing):
    mit = next(t for k, t in licences.KNOWN if k == "MIT" and len(t) > 500)
    texts = [
        mit, "Copyright (c) 2020 A. Person\n" + mit.upper().replace("LICENSE", "LICENCE"), "text\nReleased under the MIT Licence!\nLicensed under CC BY-NC 4.0", mit + " more", None, "", "All rights reserved.",
        "Licensed under the Apache License, v2.0", "© me\nReleased under the MIT License.",
    ]
    frame = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string").withColumn("license", F.lit(1)).withColumn("digest", F.lit(1))
    rows = {r["doc_id"]: tuple(r)[1:] for r in licences.scanned(frame).collect()}
    assert rows[0][0] == rows[1][0] == "MIT" and rows[3][0] is None
    assert rows[2] == (None, 2, "CC-BY-NC-4.0,MIT")
    assert rows[4] == rows[5] == rows[6] == (None, 0, "")
    assert rows[7] == ("Apache-2.0", 1, "Apache-2.0") and rows[8] == ("MIT", 1, "MIT")
    assert licences.scanned(docs).count() == docs.count() and licences.scanned(nothing).count() == 0


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 5 == 0


def test_language(spark, docs, nothing, some_docs):
    rows = language.identified(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), steps=150).collect()
    truth = {r["doc_id"]: r["lang"] for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").collect()}
    assert all(r["held_out"] == held(r["doc_id"]) and 0 <= r["score"] <= 1 for r in rows)
    tested = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == truth[r["doc_id"]] for r in tested) >= 0.95 * len(tested)
    odd = {r["doc_id"]: r for r in language.identified(docs, steps=2).collect()}
    assert len(odd) == docs.select("doc_id").distinct().count()
    assert odd[0]["lang_pred"] == odd[1]["lang_pred"] == odd[2]["lang_pred"] == "und" and odd[3]["lang_pred"] == "en"
    assert {r["lang_pred"] for r in language.identified(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.identified(nothing).count() == 0


def test_language_gradients():
    network = language.Network.new(["a", "b"], 4)
    network.weights = {k: v.astype(np.float64) for k, v in network.weights.items()}
    x, y = language.padded([b"hello wo", b"ab"], 8), np.array([0, 1])
    _, grads = network.gradients(x, y)
    for name, g in grads.items():
        at = np.unravel_index(np.abs(g).argmax(), g.shape)
        old, losses = network.weights[name][at], []
        for step in (1e-2, -1e-2):
            network.weights[name][at] = old + step
            losses.append(network.gradients(x, y)[0])
        network.weights[name][at] = old
        assert np.isclose((losses[0] - losses[1]) / 2e-2, g[at], rtol=1e-2, atol=1e-5)


def test_quality(spark, docs, nothing):
    folder = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{folder}/labels.parquet")
    rows = quality.scored(spark.read.parquet(f"{folder}/documents.parquet"), labels).collect()
    truth = {r["doc_id"]: r["quality"] for r in labels.collect()}
    tested = [r for r in rows if held(r["doc_id"]) and r["doc_id"] in truth]
    good, bad = ([r for r in tested if truth[r["doc_id"]] == q] for q in (1, 0))
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in rows)
    assert sum(r["predicted"] for r in good) >= 0.98 * len(good) and sum(r["predicted"] for r in bad) <= 0.1 * len(bad)
    none = labels.limit(0)
    assert {r["score"] for r in quality.scored(docs, none).collect()} == {0.5}
    assert quality.accepted(docs, none).count() == docs.count() and quality.scored(nothing, labels).count() == 0


def test_isotonic():
    assert quality.isotonic(np.array([1.0, 0, 0, 3]), np.array([1.0, 1, 0, 3])).tolist() == [0.5, 0.5, 0.75, 1.0]


def test_curves(spark):
    random = np.random.default_rng(1)
    centres = random.normal(size=(12, 16))
    vectors = [(centres[i % 12] * (1 + i % 3) + random.normal(0, 0.2, 16)).tolist() for i in range(900)]
    vectors += [vectors[3]] * 60 + [None, [0.0] * 16, [float("nan")] * 16, [None] * 16, [1.0] * 5]
    rows = list(enumerate(vectors)) + [(40, vectors[40]), (None, vectors[1])]
    frame = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>").withColumn("node", F.lit(1)).withColumn("vector", F.lit(1))
    found = curves.nearest_neighbours(frame)
    assert [f[0] for f in found.dtypes] == ["query_id", "rank", "vec_id", "score"]
    fine = {k: np.array(v) for k, v in rows if k is not None and v is not None and len(v) == 16 and None not in v and np.isfinite(v).all() and any(v)}
    by_query = {}
    for r in found.collect():
        assert np.isclose(r["score"], fine[r["query_id"]] @ fine[r["vec_id"]])
        by_query.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    assert set(by_query) == {k for k in fine if k % 20 == 0}
    shared = []
    for query, got in by_query.items():
        best = sorted((-round(float(fine[query] @ v), 9), k) for k, v in fine.items() if k != query)[:20]
        assert [r for r, _ in sorted(got)] == list(range(1, 21))
        shared.append(len({k for _, k in best} & {k for _, k in got}) / 20)
    assert np.mean(shared) >= 0.9
    assert curves.nearest_neighbours(frame.limit(0)).count() == 0


def test_hilbert_neighbours_touch():
    for dims, bits in ((2, 4), (3, 3), (4, 2)):
        cells = np.array(list(itertools.product(range(1 << bits), repeat=dims)))
        order = np.argsort(curves.hilbert_keys(cells, bits))
        assert (np.abs(np.diff(cells[order], axis=0)).sum(axis=1) == 1).all()


def test_recall_on_given_vectors(spark):
    frame = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = frame.collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    found = {}
    for r in curves.nearest_neighbours(frame).collect():
        found.setdefault(r["query_id"], set()).add(r["vec_id"])
    recall = []
    for q in np.flatnonzero(ids % 20 == 0):
        s = x @ x[q]
        s[q] = -9
        recall.append(len(found[ids[q]] & set(ids[np.argsort(-s)[:20]].tolist())) / 20)
    assert np.mean(recall) >= 0.9
