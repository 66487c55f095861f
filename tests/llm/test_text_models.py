"""License scan, language ID, token files."""

import zlib
from random import Random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from llm_helpers import collected, edge_docs, edge_texts, no_docs, sentence
from volpanel.llm import language_id, license_scan, token_coder, token_files
from volpanel.llm.license_texts import TEMPLATES
from volpanel.llm.queries import QUERIES

READY = [license_scan.Template(n, t, 0.8, 20) for n, t in sorted(TEMPLATES.items())]
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def common_length(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        previous = row
        row = [0]
        for j, y in enumerate(b):
            row.append(previous[j] + 1 if x == y else max(row[-1], previous[j + 1]))
    return row[-1]


@pytest.mark.parametrize("name", sorted(TEMPLATES))
def test_planted_notices_are_found(name):
    rng = Random(name)
    words = TEMPLATES[name].split()
    if len(words) >= 20:
        for _ in range(len(words) // 12):
            words[rng.randrange(len(words))] = "altered"
    notice = " ".join(words)
    before, after = sentence(1, 400), sentence(2, 300)
    found = license_scan.scan_text(f"{before}\n{notice}\n{after} the license of the software {notice}", READY)
    assert [x[2] for x in found] == [name, name]
    n = len(license_scan.WORDS.findall(notice.lower()))
    template = license_scan.WORDS.findall(TEMPLATES[name].lower())
    for start, end, _, coverage in found:
        assert end - start <= n
        best = common_length(template, license_scan.WORDS.findall(notice.lower())) / len(template)
        assert coverage == pytest.approx(best, abs=0.02)
    assert 0 <= found[0][0] - len(license_scan.WORDS.findall(before)) <= 3


def test_nothing_is_found_where_the_longest_common_part_is_short():
    rng = Random(3)
    pool = sorted({w for t in READY for w in t.words})
    for _ in range(20):
        text = " ".join(rng.choice(pool) for _ in range(400))
        found = {x[2] for x in license_scan.scan_text(text, READY)}
        for template in READY:
            if common_length(template.words, text.split()) < template.need:
                assert template.name not in found


@pytest.mark.parametrize("order", ["nen", "enn", "nne", "nenen"])
def test_altered_notices_are_found_next_to_a_longer_excerpt(order):
    name = max(TEMPLATES, key=lambda n: len(TEMPLATES[n].split()))
    words = license_scan.WORDS.findall(TEMPLATES[name].lower())
    altered = " ".join("zzz" if i % 11 == 5 else w for i, w in enumerate(words))
    excerpt = " ".join(words[len(words) // 2 :][:40])
    text = " ".join({"n": altered, "e": excerpt}[c] + " Some other words stand here. " for c in order)
    found = license_scan.scan_text(text, [t for t in READY if t.name == name])
    assert len(found) == order.count("n")
    assert all(coverage >= 0.85 for *_, coverage in found)


def test_many_altered_copies_are_all_found():
    rng = np.random.default_rng(3)
    words = license_scan.WORDS.findall(TEMPLATES["MIT"].lower())
    copies = [" ".join(str(rng.choice(words)) if rng.random() < 0.1 else w for w in words) + " one two" for _ in range(60)]
    found = license_scan.scan_text(" ".join(copies), [t for t in READY if t.name == "MIT"])
    assert [start // (len(words) + 2) for start, *_ in found] == list(range(60))


def test_longest_rising():
    rng = Random(1)
    for _ in range(50):
        values = [rng.randrange(30) for _ in range(12)]
        got = [values[i] for i in license_scan.longest_rising(values)]
        best = max(bin(m).count("1") for m in range(1 << 12) if (s := [v for i, v in enumerate(values) if m >> i & 1]) == sorted(set(s)))
        assert got == sorted(set(got)) and len(got) == best


def test_license_scan_edges(spark):
    found = license_scan.scan_licenses(edge_docs(spark), TEMPLATES)
    assert found.count() == len(edge_texts())
    assert found.where("size(licenses) > 0").isEmpty()
    assert license_scan.scan_licenses(no_docs(spark), TEMPLATES).count() == 0


def test_language_is_right_on_held_out_texts(spark):
    sf = "/root/testdata/sf0.01"
    found = {r["doc_id"]: r for r in QUERIES["op5_language_id"](spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "lang").collect()
    assert len(found) == len(docs)
    for d in docs:
        assert found[d["doc_id"]]["held_out"] == (zlib.crc32(str(d["doc_id"]).encode()) % 3 == 1)
    aside = [d for d in docs if found[d["doc_id"]]["held_out"]]
    right = [found[d["doc_id"]]["lang_pred"] == d["lang"] for d in aside]
    assert np.mean(right) > 0.98
    assert all(0 <= r["score"] <= 1 for r in found.values())


def test_language_edges(spark):
    found = language_id.identify(edge_docs(spark)).collect()
    assert len(found) == len(edge_texts())
    silent = {5, 6, 7, 8}
    assert all((r["lang_pred"] == "und") == (r["doc_id"] in silent) for r in found if r["doc_id"] is not None)
    assert language_id.identify(no_docs(spark)).count() == 0
    model = language_id.fit(no_docs(spark))
    assert model.scores("text") == ("und", 0.0)


@pytest.mark.parametrize("hot", range(4))
def test_language_sample_is_distinct_and_balanced(spark, monkeypatch, hot):
    texts = [(sentence(hot * 1000 + i, 9), k) for k, n in (("aa", 60), ("bb", 300), ("cc", 8)) for i in range(n)]
    docs = spark.createDataFrame(texts + [texts[0]] * 5000, "text string, lang string").repartition(4)
    staged = []
    keep = language_id.stage
    monkeypatch.setattr(language_id, "stage", lambda df, label: staged.append(keep(df, label)) or staged[-1])
    language_id.fit(docs, max_training=60)
    sample = [(r["label"], bytes(r["slots"]), bytes(r["values"])) for r in staged[0].collect()]
    assert [sum(k == label for k, *_ in sample) for label in range(3)] == [20, 20, 8]
    assert len(set(sample)) == len(sample)


def test_ftrl_weights_are_sparse_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    rows = [(np.array([k * 10 + i, 500]), np.array([1.0, 1.0]), k) for k in range(3) for i in rng.integers(0, 5, 60)]
    weights = language_id.train_ftrl(rows, 3)
    assert (np.argmax([r[1] @ weights[r[0]] for r in rows], axis=1) == [r[2] for r in rows]).mean() == 1.0
    assert not weights[[5, 6, 29, 700]].any()
    logits = rng.normal(size=(4000, 3)) * 2
    p = language_id._softmax(logits)
    labels = (p.cumsum(axis=1) > rng.random((4000, 1))).argmax(axis=1)
    assert language_id.fit_temperature(logits * 5, labels) == pytest.approx(5, rel=0.15)


@pytest.mark.parametrize("n,top", [(0, 1), (1, 50256), (257, 3), (5000, 50256), (3000, 1 << 19)])
def test_coder_round_trip(n, top):
    rng = np.random.default_rng(n)
    ids = np.where(rng.random(n) < 0.5, rng.integers(0, top + 1, n), np.arange(n) % 7 % (top + 1))
    block, levels = token_coder.block_size(n), token_coder.levels_for(top)
    payloads = token_coder.encode(ids, block, levels)
    assert len(payloads) == -(-n // block)
    assert (token_coder.decode(payloads, n, block, levels) == ids).all()


def test_coder_learns():
    ids = np.tile(np.arange(40_000, 40_050), 80)
    assert sum(map(len, token_coder.encode(ids, 4096, 4))) < 0.2 * 4 * len(ids) / 2


def test_blocks_are_checked_and_independent():
    bodies = [np.arange(i, i + 700, dtype="<u4").tobytes() for i in (5, 9)]
    data = token_files.pack_segment(3, 4, [None, 8], bodies)
    assert token_files.unpack_segment(data + b"\n") == (3, 4, [None, 8], bodies)
    with pytest.raises(ValueError, match="damaged"):
        token_files.unpack_segment(data[:-40] + bytes([data[-40] ^ 1]) + data[-39:])


def test_coder_knows_counts():
    rng = np.random.default_rng(5)
    ids = np.minimum(rng.geometric(0.01, 40_000), 900)
    counts = np.bincount(ids)
    share = counts[counts > 0] / len(ids)
    payloads = token_coder.encode(ids, 2048, 3, counts)
    assert (token_coder.decode(payloads, len(ids), 2048, 3, counts) == ids).all()
    assert sum(map(len, payloads)) * 8 < len(ids) * (0.3 - (share * np.log2(share)).sum())


def test_words_are_coded_as_one():
    coder = token_files.Encoder(TOKENIZER)
    words = [f"unsayable{i}ness" for i in range(40)]
    texts = [" ".join(words[(i * j) % 40] for j in range(300)) for i in range(1, 30)]
    docs = [np.append(coder.units(t), coder.singles(np.array([0]))) for t in texts]
    data = token_files.pack_units(0, 0, list(range(len(docs))), docs, *coder.table())
    bodies = [coder.encode(t) + bytes(4) for t in texts]
    assert token_files.unpack_segment(data) == (0, 0, list(range(len(docs))), bodies)
    assert token_files.HEAD.unpack_from(data)[8] == 301 * len(texts)
    assert len(data) < 0.12 * sum(map(len, bodies)) / 4


def test_rare_words_are_forgotten(monkeypatch):
    monkeypatch.setattr(token_files, "CACHED_UNITS", 60)
    coder, fresh = token_files.Encoder(TOKENIZER), token_files.Encoder(TOKENIZER)
    for i in range(12):
        texts = [f"the same words again {i} w{i}x{j} a  b" if j % 3 == 0 else f"the same words w{i}x{j}" for j in range(20)]
        docs = [coder.units(t) for t in texts]
        lengths, ids = coder.table()
        starts = np.cumsum(lengths) - lengths
        for text, units in zip(texts, docs):
            assert ids[token_files.spread(starts[units], lengths[units])].tobytes() == fresh.encode(text)
        coder.forget(docs)
        assert len(coder.lengths) == coder.count <= 60 + 80


TRICKY = ["", " a", "a ", "a  b", "a \n b", "a\n\n b\t c", "it's 's 12 a1 ?!", "<|endoftext|> x <|endoftext|>", "É ñ\u00a0x \u3000y", "日本 語\n", "a\r\n b"]


def test_words_encode_like_whole_texts():
    encoder = token_files.Encoder(TOKENIZER)
    plain = Tokenizer.from_file(TOKENIZER)
    for text in TRICKY + [sentence(i, 200) for i in range(5)]:
        want = plain.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == want


def encoded_plainly(texts):
    plain = Tokenizer.from_file(TOKENIZER)
    out, at = [], 0
    for doc, text in texts:
        ids = np.asarray(plain.encode(text or "", add_special_tokens=False).ids + [0], dtype="<u4")
        out.append((doc, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    return out


def test_token_files_round_trip(spark):
    texts = [(i * 3 % 101, t) for i, t in enumerate(TRICKY + [None] + [sentence(i, 50 + i) for i in range(60)])]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = token_files.round_trip(docs, TOKENIZER)
    assert collected(found, "doc_id", "start", "n_tokens", "ids_crc32") == encoded_plainly(sorted(texts, key=lambda t: t[0]))


def test_token_files_edges(spark):
    assert token_files.round_trip(no_docs(spark), TOKENIZER).count() == 0
    found = token_files.round_trip(edge_docs(spark), TOKENIZER).collect()
    assert len(found) == len(edge_texts())
    found.sort(key=lambda r: r["start"])
    assert [r["start"] for r in found[1:]] == list(np.cumsum([r["n_tokens"] for r in found])[:-1])
    ids = [r["doc_id"] for r in found]
    assert ids == sorted(ids, key=lambda d: (d is not None, d))
