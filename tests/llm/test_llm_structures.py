"""Byte-level BPE, Merkle manifest and prefix trie against brute force."""

import base64
import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from orthomark.llm import byte_bpe, decontamination, merkle, prefix_trie, quality, queries

# --- byte-level BPE -----------------------------------------------------------------------


@pytest.fixture(scope="module")
def library():
    import tiktoken

    with open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def odd_texts():
    rng = random.Random(5)
    texts = ["", " ", "\n", "  a", "a  ", "I'll don't 've", "<|endoftext|> x", "x" * 5000, "ab" * 3000, " " * 700 + "end", "é" * 300,
             "日本語のテキスト" * 40, "\U0001f600\U0001f3fd‍" * 30, "\u0085 \x1c\x1f　 z", "9" * 200, "?!" * 400]
    texts += ["".join(rng.choice("etaoin \n\t'sé1.,!") for _ in range(rng.randrange(1, 300))) for _ in range(200)]
    return texts


def test_bpe_equals_library(library):
    encoder = byte_bpe.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text, ids in zip(odd_texts(), encoder.encode(odd_texts())):
        assert ids.tolist() == library.encode_ordinary(text), text[:60]


def test_bpe_trees_agree(library):
    """The trees side by side and the single tree, on the same random matches of all small sizes."""
    table = byte_bpe.ranks_of(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    rng = random.Random(7)
    for leaves in (2, 4, 8, 16, 32, 64):
        pieces = ["".join(rng.choice("abcdeé ü") for _ in range(rng.randrange(1, leaves + 1))).encode()[:leaves] for _ in range(150)]
        pieces = [p for p in pieces if p]
        ids, counts = byte_bpe.merge_short(pieces, leaves, table)
        ends = np.cumsum(counts)
        assert [ids[e - c:e].tolist() for e, c in zip(ends, counts)] == [byte_bpe.merge_long(p, table.ranks) for p in pieces]


def test_bpe_segments(library, monkeypatch):
    monkeypatch.setattr(byte_bpe, "STEP", 50)
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 20)
    encoder = byte_bpe.Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    for text in ["some words  and   spaces\n \n here " * 30, "x" * 200, *odd_texts()[-40:]]:
        assert "".join(encoder.segments(text)) == text
        assert encoder.encode([text])[0].tolist() == library.encode_ordinary(text)


def test_bpe_operator(spark, library):
    rows = [(1, None, "a", 3), (2, "", "b", 4), (3, "same text", "c", 5), (3, "same text", "c", 5), (None, "no id", None, None), (5, " ".join(odd_texts()), "d", 6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, decoded string, _text int")
    found = byte_bpe.encode(docs, keep=("doc_id", "decoded"))
    assert found.columns == ["doc_id", "decoded", "ids"]
    got = sorted((r.doc_id or 0, np.frombuffer(r.ids, "<u4").tolist(), r.decoded) for r in found.collect())
    assert got == sorted((i or 0, library.encode_ordinary(t or ""), d) for i, t, d, _ in rows)
    back = byte_bpe.decode(found.drop("decoded"), keep=("doc_id",))
    assert sorted((r.doc_id or 0, r.decoded.decode()) for r in back.collect()) == sorted((i or 0, t or "") for i, t, _, _ in rows)
    assert byte_bpe.encode(docs.limit(0)).count() == 0
    with pytest.raises(ValueError):
        byte_bpe.decode(found, keep=("decoded",))


def test_bpe_query(spark, library, tmp_path):
    rows = [(i, t) for i, t in enumerate(odd_texts())] + [(900, None)]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    want = []
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        want.append((i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()))
    assert sorted(tuple(r) for r in queries.QUERIES["op11_byte_bpe"](spark, str(tmp_path)).collect()) == sorted(want)


# --- Merkle manifest ----------------------------------------------------------------------

def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def brute_levels(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k:k + 16])) for k in range(0, len(levels[-1]), 16)])
    return levels


def steps_of(levels, at):
    out = []
    for nodes in levels[:-1]:
        first = at - at % 16
        out.append(("".join(nodes[first:at]), "".join(nodes[at + 1:first + 16])))
        at //= 16
    return out


def brute_manifest(rows):
    """rows (doc_id, source, lang, n_chars, text) -> doc_id, leaf, subroot, root, proof_sha256, folded_root, verified."""
    def leaf(row, lower=False):
        values = list(row[:4]) + [row[4] if row[4] is None or not lower else "".join(c.lower() if "A" <= c <= "Z" else c for c in row[4])]
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))

    groups = {}
    for row in rows:
        groups.setdefault(row[1], []).append(row)
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    for source in order:
        groups[source].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    trees = [brute_levels([leaf(r) for r in groups[s]]) for s in order]
    top = brute_levels([t[-1][0] for t in trees])
    out = []
    for number, (source, levels) in enumerate(zip(order, trees)):
        for at, row in enumerate(groups[source]):
            steps = steps_of(levels, at) + steps_of(top, number)
            altered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 5 == 0
            current = leaf(row, altered)
            for left, right in steps:
                current = sha(left + current + right)
            out.append((row[0], levels[0][at], levels[-1][0], top[-1][0], sha("".join(a + b for a, b in steps)), current, current == top[-1][0]))
    return sorted(out, key=repr)


DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def merkle_rows(seed, sizes):
    rng = random.Random(seed)
    rows = []
    for source, size in sizes.items():
        for _ in range(size):
            rows.append((rng.choice([None, rng.randrange(10**6), rng.randrange(2**60)]) if rng.random() < .1 else rng.randrange(10**6), source,
                         rng.choice([None, "en", "dé"]), rng.choice([None, 1, 10**12]), rng.choice([None, "", "Text " * rng.randrange(9), "ÀBC é"])))
    rows += [rows[0]] * 5  # repeated rows
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("levels", [1, 2, 3])
@pytest.mark.parametrize("sizes", [{None: 1, "": 16, "a": 17, "B": 300, "é": 4, "z" * 50: 257}, {"only": 1}, {f"s{k}": k % 3 + 1 for k in range(40)}])
def test_merkle(spark, monkeypatch, tmp_path, levels, sizes):
    rows = merkle_rows(3, sizes)
    monkeypatch.setattr(merkle, "LEVELS", levels)
    spark.createDataFrame(rows, DOCS).repartition(7).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.QUERIES["op12_merkle"](spark, str(tmp_path)).collect()
    assert sorted((tuple(r) for r in got), key=repr) == brute_manifest(rows)


def test_merkle_proofs_and_roots(spark):
    """The siblings themselves lead from any leaf to the root; a table of clashing columns; whole numbers beyond doubles."""
    rows = merkle_rows(4, {"x": 70, None: 3}) + [(2**60 + 1, "x", "en", 1, "t"), (2**60 + 3, "x", "en", 1, "t")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("leaf", F.lit(1)).withColumn("root", F.lit("r")).withColumn("_at", F.lit(True))
    found = merkle.proofs(docs, "source", ["doc_id"], with_proofs=True, levels=1).collect()
    for row in found:
        current = row.leaf
        for step in row.proof:
            current = sha(step.left + current + step.right)
        assert current == row.root == row.folded_root
    assert {2**60 + 1, 2**60 + 3} <= {r.doc_id for r in found}
    manifest = merkle.roots(docs, "source", ["doc_id"]).collect()
    assert {(r.source, r.n_leaves) for r in manifest} == {("x", sum(r[1] == "x" for r in rows)), (None, sum(r[1] is None for r in rows))}
    assert {r.root for r in manifest} == {found[0].root} and {r.subroot for r in manifest} == {r.subroot for r in found}


def test_merkle_empty(spark):
    docs = spark.createDataFrame([], DOCS)
    assert merkle.proofs(docs, "source", ["doc_id"]).count() == 0
    assert merkle.roots(docs, "source", ["doc_id"]).count() == 0


# --- prefix trie --------------------------------------------------------------------------

def brute_trie(rows):
    """rows (conv_id, turn, role, text) -> nodes, by a dictionary of prefixes."""
    turns = {}
    for conv, turn, role, text in rows:
        if conv is not None:
            turns.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    turns = {c: [(r, t) for _, _, r, t in sorted(v)] for c, v in turns.items()}
    members, ends = {}, {}
    for conv, own in turns.items():
        h = zlib.crc32(str(conv).encode()) % 6
        base = conv - int(np.fmod(conv, 100))
        whole = tuple(turns.get(base, [])[:h] + own[h:])
        ends.setdefault(whole, []).append(conv)
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append(conv)
    children, leaves, saved = {}, {}, {}
    for node in members:
        if node:
            children[node[:-1]] = children.get(node[:-1], 0) + 1
    for node, own in members.items():
        for d in range(len(node) + 1):
            leaves[node[:d]] = leaves.get(node[:d], 0) + (node not in children)
            saved[node[:d]] = saved.get(node[:d], 0) + (len(own) - 1) * (len(node[-1][1]) if node else 0)
    return sorted((min(own), len(node), min(members[node[:-1]]) if node else None, len(own), children.get(node, 0), leaves[node], saved[node],
                   sha(",".join(map(str, sorted(ends.get(node, [])))))) for node, own in members.items())


def sorted_nodes(found):
    return sorted((tuple(r) for r in found.collect()), key=lambda r: (r[0], r[1]))


def run_trie(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("key", F.lit("x")).withColumn("pos", F.lit(1)).withColumn("_n", F.lit(2))
    return sorted_nodes(prefix_trie.trie(prefix_trie.share_openings(prefix_trie.turns_of(table))))


def conversations(seed, convs, longest=7, ids=None):
    rng = random.Random(seed)
    rows = []
    for c in ids or range(convs):
        for turn in range(rng.randrange(1, longest)):
            rows.append((c, rng.choice([None, turn, turn]) if rng.random() < .1 else turn, rng.choice([None, "user", "assistant"]), rng.choice([None, "", "a", "bé", "long text"])))
    rows += rows[:3]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,rows", [
    (1, conversations(1, 250)),
    (2, conversations(2, 0, ids=[-250, -99, -5, 0, 3, 99, 100, 101, 7_000_000_000, 7_000_000_001])),
    (3, [(5, 1, "user", "x")]),  # its base is absent: turnless where h > 0
    (4, [(c, t, "user", "same") for c in range(60) for t in range(3)] + [(None, 1, "user", "lost")]),
    (5, [(200, t, "user", str(t % 5)) for t in range(500)] + [(201, t, "user", "other") for t in range(300)]),
])
def test_trie(spark, monkeypatch, seed, rows):
    monkeypatch.setattr(prefix_trie, "CHUNK", 16)
    monkeypatch.setattr(prefix_trie, "LISTED", 7)
    assert run_trie(spark, rows) == brute_trie(rows)


def test_trie_of_hot_parents(spark, monkeypatch):
    """Parents of many children are met by broadcast, all others by a join; the result is the same."""
    monkeypatch.setattr(prefix_trie, "LEAST_HOT", 2)
    rows = conversations(6, 300)
    assert run_trie(spark, rows) == brute_trie(rows)


def test_trie_empty(spark):
    assert run_trie(spark, [(None, 1, "user", "x")]) == []


# --- columns of the caller ----------------------------------------------------------------

def test_callers_columns_come_back(spark):
    """Columns that have the names of results keep their values and types in the helpers that promise rows as they are."""
    passage = " ".join(f"w{k}" for k in range(20))
    rows = [(k, passage if k == 3 else f"other words {k} " * 5, "mine", [k], 1.5, "s", {"a": k}, k % 2 == 0, "key") for k in range(8)]
    schema = "doc_id long, text string, n_words string, items array<int>, n_hit double, spans string, n_grams map<string,int>, log_weight boolean, sample_key string"
    docs = spark.createDataFrame(rows, schema)
    bench = spark.createDataFrame([(1, passage)], "item_id long, text string")
    left = decontamination.remove_documents(docs, bench)
    assert left.schema == docs.schema and sorted(tuple(r) for r in left.drop("n_grams").collect()) == sorted((*r[:6], *r[7:]) for r in rows if r[0] != 3)
    cut = decontamination.remove_spans(docs, bench)
    assert cut.schema == docs.schema and {r.doc_id: (r.n_words, r.items, r.n_grams) for r in cut.collect()} == {r[0]: (r[2], r[3], r[6]) for r in rows}
    kept = quality.keep_sampled(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert kept.schema == docs.schema and {r.doc_id: (r.n_grams, r.log_weight, r.sample_key) for r in kept.collect()} == {r[0]: r[6:] for r in rows}
