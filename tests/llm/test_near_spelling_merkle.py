"""SimHash links, spelling variants and Merkle proofs next to plain versions."""

import hashlib
import random
import re
import zlib
from collections import Counter
from itertools import combinations

import numpy as np
import pytest
import xxhash
from llm_helpers import DOC_SCHEMA, WORD, collected, edge_docs, edge_texts, lower, no_docs, rows, sentence
from pyspark.sql import functions as F

from volpanel.llm import merkle, simhash, spelling

LETTERS = re.compile("[A-Za-zÀ-ÿ]+")


def plain_fingerprint(text):
    words = WORD.findall(lower(text))
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def near_components(prints, bits=3):
    label = list(range(len(prints)))

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for i, j in combinations(range(len(prints)), 2):
        if (prints[i] ^ prints[j]).bit_count() <= bits:
            label[root(i)] = root(j)
    return [root(i) for i in range(len(prints))]


def plain_near(texts):
    prints = [plain_fingerprint(t) for _, t in texts]
    roots = near_components(prints)
    least = {}
    for (doc, _), r in zip(texts, roots):
        have = least.get(r)
        least[r] = doc if have is None else have if doc is None else min(have, doc)
    return [(doc, f"{p:016x}", least[r]) for (doc, _), p, r in zip(texts, prints, roots)]


def test_position_sets_lie_in_any_five():
    sets = [set(p) for p in simhash.position_sets()]
    assert len(sets) == 14 and all(len(p) == 4 for p in sets)
    assert all(any(p <= set(five) for p in sets) for five in combinations(range(8), 5))


def test_finer_masks_lose_no_near_pair():
    rng = random.Random(5)
    for mask in simhash.first_masks():
        for _ in range(50):
            differ = 0
            for bit in rng.sample([i for i in range(64) if not mask >> i & 1], 3):
                differ |= 1 << bit
            finer = [m for m in simhash.finer_masks(mask) if not differ & m]
            assert finer and all(m & mask == mask for m in finer)
            assert any(not differ & m for f in finer for m in simhash.finer_masks(f))


def test_fingerprints_and_components(spark):
    texts = [(t[0], t[1]) for t in edge_texts()]
    texts += [(100 + i, " ".join([*sentence(7, 400).split()[: 300 + i % 3], f"tail{i}"])) for i in range(30)]
    docs = spark.createDataFrame(rows([(i, t, "en", "a") for i, t in texts]), DOC_SCHEMA)
    want = sorted(plain_near(texts), key=str)
    assert sorted((tuple(r) for r in simhash.near_duplicates(docs).collect()), key=str) == want
    assert len({r[2] for r in want}) < len(want)


@pytest.mark.parametrize("list_rows", [60, 2048])
def test_crowded_lists_lose_no_link(spark, list_rows):
    """Fingerprints in dense clusters, with lists split down to single bits where the limit is small."""
    rng = np.random.default_rng(3)
    centres = rng.integers(0, 1 << 63, size=4, dtype=np.uint64)
    prints = set()
    for i in range(500):
        value = int(centres[i % 4])
        for bit in rng.integers(0, 64, size=int(rng.integers(0, 7))):
            value ^= 1 << int(bit)
        prints.add(value)
    prints = sorted(prints) + [0, 7, (1 << 64) - 1]
    frame = spark.createDataFrame([(simhash._signed(p),) for p in prints], "print bigint")
    links = simhash.fingerprint_links(frame, list_rows).collect()
    assert all(((r.a % (1 << 64)) ^ (r.b % (1 << 64))).bit_count() <= 3 for r in links)
    label = {p: p for p in prints}

    def root(p):
        while label[p] != p:
            p = label[p]
        return p

    for r in links:
        label[root(r.a % (1 << 64))] = root(r.b % (1 << 64))
    want = near_components(prints)
    pairs = {(i, j) for i, j in combinations(range(len(prints)), 2) if want[i] == want[j]}
    assert pairs == {(i, j) for i, j in combinations(range(len(prints)), 2) if root(prints[i]) == root(prints[j])}
    assert len(links) < 14 * len(prints)


def test_hot_copies_and_empty_table(spark):
    texts = [(i, sentence(1, 50) if i % 3 else None) for i in range(300)]
    docs = spark.createDataFrame(rows([(i, t, "en", "a") for i, t in texts]), DOC_SCHEMA)
    found = collected(simhash.near_duplicates(docs), "doc_id", "component_id")
    assert found == [(i, 1 if i % 3 else 0) for i in range(300)]
    assert simhash.near_duplicates(no_docs(spark)).collect() == []


def plain_variants(texts, damage=97):
    counts = Counter()
    for doc, text in texts:
        for run in LETTERS.findall(text or ""):
            run = lower(run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if damage and h % damage == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            counts[run] += 1
    counts = {w: n for w, n in counts.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    out, form = [], {}
    for w in counts:
        others = sorted((-counts[o], o) for o in counts if o != w and near(w, o))
        form[w] = others[0][1] if others and -others[0][0] >= 2 * counts[w] else None
        out.append((w, len(others)))
    result = []
    for w, n_near in out:
        root = w
        while form[root]:
            root = form[root]
        result.append((w, form[w], root, counts[w], n_near, counts[form[w]] if form[w] else None))
    return sorted(result)


def spelled(seed):
    rng = random.Random(seed)
    base = ["zauber", "bookkeeper", "aaaaaa", "straße", "élève", "mixture", "ocean", "abcdefgh", "aabbaabb"]
    texts = []
    for i in range(400):
        words = []
        for _ in range(12):
            w = rng.choice(base)
            if rng.random() < 0.4:
                at = rng.randrange(len(w))
                w = rng.choice([w[:at] + w[at + 1 :], w[:at] + rng.choice("abeé") + w[at:], w[:at] + rng.choice("abeé") + w[at + 1 :]])
            words.append(w.upper() if rng.random() < 0.1 else w)
        texts.append((None if i % 50 == 0 else i, " ".join(words)))
    return texts


@pytest.mark.parametrize("damage", [97, 5, None])
def test_variants(spark, damage):
    texts = [(t[0], t[1]) for t in edge_texts()] + spelled(1)
    docs = spark.createDataFrame(rows([(i, t, "en", "a") for i, t in texts]), DOC_SCHEMA)
    want = plain_variants(texts, damage)
    assert collected(spelling.variants(docs, damage=damage), "word", "form", "root", "n", "n_near", "form_n") == want
    assert any(w[1] for w in want) and any(w[4] > 3 for w in want)


def test_very_long_word_and_empty_table(spark):
    long = "ab" * 20_000
    texts = [(i, long + ("a" if i % 2 else "") + " word") for i in range(12)]
    docs = spark.createDataFrame(rows([(i, t, "en", "a") for i, t in texts]), DOC_SCHEMA)
    found = collected(spelling.variants(docs, damage=None), "word", "n", "n_near")
    assert found == [(long, 6, 1), (long + "a", 6, 1)]
    assert spelling.variants(no_docs(spark)).collect() == []


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def plain_tree(leaves):
    """Top and, per leaf, the (left, right) siblings of each level."""
    paths, nodes, of = [[] for _ in leaves], list(leaves), list(range(len(leaves)))
    while len(nodes) > 1:
        for leaf, at in enumerate(of):
            first = at // 3 * 3
            run = nodes[first : first + 3]
            paths[leaf].append(("".join(run[: at - first]), "".join(run[at - first + 1 :])))
        nodes = [sha(*nodes[i : i + 3]) for i in range(0, len(nodes), 3)]
        of = [at // 3 for at in of]
    return nodes[0], paths


def plain_manifest(docs, tamper):
    """docs: (doc_id, text, lang, source)."""
    groups = {}
    for doc, text, lang, source in docs:
        leaf = sha(field(doc), field(source), field(lang), field(text))
        hit = doc is not None and text is not None and tamper and zlib.crc32(str(doc).encode()) % 2 == 0
        start = sha(field(doc), field(source), field(lang), field(text.replace("\n", ""))) if hit else leaf
        groups.setdefault(source, []).append((doc is not None, doc or 0, leaf, start, doc))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: plain_tree([r[2] for r in sorted(groups[s])]) for s in order}
    root, crown = plain_tree([trees[s][0] for s in order])
    out = []
    for s, above in zip(order, crown):
        top, paths = trees[s]
        for row, path in zip(sorted(groups[s]), paths):
            whole, at = path + above, row[3]
            for left, right in whole:
                at = sha(left, at, right)
            proof = sha(*[left + right for left, right in whole])
            out.append((row[4], row[2], top, root, proof, at, at == root))
    return out


@pytest.mark.parametrize("levels", [1, 2, 9])
def test_manifest(spark, levels):
    texts = [(t[0], t[1], t[2], t[3]) for t in edge_texts()]
    texts += [(1000 + i, f"line {i}\nnext", "en", "big") for i in range(250)]
    texts += [(5000 + i, "x\ny", None, f"source {i:02d}") for i in range(13)]
    texts += [(7, "same\n", "en", "twice")] * 5
    docs = spark.createDataFrame(rows(texts), DOC_SCHEMA)
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 2 == 0
    arrived = F.when(hit, F.replace("text", F.lit("\n"), F.lit(""))).otherwise(F.col("text"))
    fields = ("doc_id", "source", "lang", "text")
    found = merkle.manifest(docs, fields=fields, received={"text": arrived}, levels=levels)
    columns = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    want = plain_manifest(texts, True)
    assert sorted((tuple(r) for r in found.select(*columns).collect()), key=str) == sorted(want, key=str)
    assert {r[-1] for r in want} == {True, False}


def test_manifest_without_changes_and_empty(spark):
    fields = ("doc_id", "source", "lang", "text")
    found = merkle.manifest(edge_docs(spark), fields=fields)
    assert found.where("NOT verified").isEmpty() and found.count() == len(edge_texts())
    assert merkle.manifest(no_docs(spark), fields=fields).collect() == []


def test_one_row_is_its_own_root(spark):
    docs = spark.createDataFrame(rows([(1, "a", "en", None)]), DOC_SCHEMA)
    row = merkle.manifest(docs, fields=("doc_id", "source", "lang", "text")).first()
    assert row.root == row.subroot == row.leaf and row.path == [] and row.proof_sha256 == sha()
