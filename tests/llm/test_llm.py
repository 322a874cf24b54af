"""The training-data operators against the libraries, brute force and SQL, with their edge cases."""

import hashlib
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sieveloom.llm import queries, words
from sieveloom.llm.chat import read_back, windows
from sieveloom.llm.common import components, table
from sieveloom.llm.embeddings import candidates, near_vectors
from sieveloom.llm.labelled import sample
from sieveloom.llm.lm import backoff_scores, exploded
from sieveloom.llm.minhash import deduplicate, near_duplicates
from sieveloom.llm.packing import Limits, Packer, encoding, pack
from sieveloom.llm.pieces import CharacterMap, Pieces, encode_pieces
from sieveloom.llm.quality import classify_quality, features, fit_quality, shape
from sieveloom.llm.rules import fences, judge, measures
from sieveloom.llm.token_counts import PrefixCounter, count_tokens, kept
from sieveloom.llm.toxicity import INSULT, Grammar, classify_toxicity, fit_toxicity

from ..conftest import DATA

TEXTS = [None, "", " ", "\n\t x", "word", "a<|endoftext|>b", "I'll 've 'S 12345 ½ÀÉ ΣΑΣ", "日本語テキスト — “quotes” œ", "▁a ▁▁ b", "  lead and   trail  ", "é" * 30 + "́", "x" * 3000, "the same words again and again " * 400, "word", "<0x41> </s> [INST]", "\x00\x7f"]


@pytest.fixture(scope="module")
def docs(spark):
    """Null, empty, long and repeated texts, with columns whose names clash with outputs."""
    rows = [(k, x, "en", "s", 7, "mine") for k, x in enumerate(TEXTS)] + [(4, "word", "en", "s", 7, "mine"), (99, "one two", None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, score int, n_tokens string")


@pytest.fixture(scope="module")
def hostile():
    rng = random.Random(3)
    return [x or "" for x in TEXTS] + ["".join(rng.choices("abAB 12.,'!?\n\té ñßΣÖ日😀<|>▁", k=rng.randint(1, 40))) for _ in range(800)]


def test_token_counts_and_all_prefixes(hostile):
    c = PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))
    size = lambda x: len(c.library.encode(x, add_special_tokens=False).ids)
    assert [x for x in hostile if c.total(x) != size(x)] == []
    for x in [x for x in hostile if "<|" not in x and len(x) < 60][:60]:
        normal = c.library.normalizer.normalize_str(x) if x else ""
        assert c.table(x) == [size(normal[:k]) for k in range(len(normal) + 1)]


def test_token_count_columns(spark, docs):
    rows = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).collect()
    assert len(rows) == docs.count() and rows[0].n_tokens == rows[0].n_bytes == 0 and rows[0].score == 7
    long = next(r for r in rows if r.doc_id == 12)
    assert long.over_limit and long.kept_tokens <= 2048 and long.prefix_tokens[long.kept_words - 1] == long.kept_tokens and long.prefix_tokens[long.kept_words] > 2048
    c = PrefixCounter(public_tokenizers.path("word_bpe_49k.json"))
    other = count_tokens(docs, public_tokenizers.path("word_bpe_49k.json")).withColumn("k", kept("prefix_tokens", 100)).where("doc_id = 12").first()
    assert other.n_tokens == other.prefix_tokens[-1] == c.total(TEXTS[12]) and other.prefix_tokens[other.k - 1] <= 100 < other.prefix_tokens[other.k]


def test_pieces(spark, docs, hostile):
    path = public_tokenizers.path("piece_bpe_32k.model")
    own, library = Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    for x in hostile:
        ids, bounds = own.encode(x)
        assert ids.tolist() == library.encode(x)
        assert own.decode(ids.tolist()) == library.decode(ids.tolist())
        assert bounds[1:].tolist() == [p.end for p in library.encode(x, return_type="proto").pieces]
    rows = encode_pieces(docs, path).collect()
    assert len(rows) == docs.count() and all(len(r.bounds) == len(r.ids) + 1 for r in rows)


def test_character_map():
    """A trie of one key, 'a' to 'bc': root, then 'a' with a leaf, then the leaf's value."""
    units = [0] * 512
    units[0] = 256 << 10
    units[256 ^ 0x61] = (1 << 8) | ((256 ^ 0x61 ^ 3) << 10) | 0x61
    units[3] = 0x80000000
    m = CharacterMap(struct.pack("<I", 4 * len(units)) + struct.pack(f"<{len(units)}I", *units) + b"bc\0")
    assert m.longest(b"xa", 1) == (1, b"bc") and m.longest(b"xa", 0) is None and CharacterMap(b"").longest(b"a", 0) is None


@pytest.mark.parametrize("rule", ["nmt_nfkc", "nfkc_cf"])
def test_pieces_with_a_compiled_map(tmp_path, hostile, rule):
    """The public model has no map, so it is given the library's own ones."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    model, maps = pb.ModelProto(), pb.ModelProto()
    model.ParseFromString(open(public_tokenizers.path("piece_bpe_32k.model"), "rb").read())
    maps.ParseFromString(sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto())
    model.normalizer_spec.CopyFrom(maps.normalizer_spec)
    path = str(tmp_path / "mapped.model")
    open(path, "wb").write(model.SerializeToString())
    own, library = Pieces(path), sentencepiece.SentencePieceProcessor(model_file=path)
    rng = random.Random(6)
    odd = ["".join(rng.choices("ﬁ½Åå①ｶﾞ㍿ǅ ­​\u3000\u0301eEſK‥…™ﷺ가각 \t\x01日", k=rng.randint(1, 25))) for _ in range(800)]
    for x in [*hostile, *odd]:
        ids, bounds = own.encode(x)
        assert ids.tolist() == library.encode(x), x
        assert bounds[1:].tolist() == [p.end for p in library.encode(x, return_type="proto").pieces], x


@pytest.mark.parametrize("name", sorted(queries.ORACLE))
def test_sql(spark, duck, same, name):
    same(queries.QUERIES[name](spark, DATA).toPandas(), duck.execute(queries.ORACLE[name]).df())


def test_empty_tables(spark, docs):
    none = docs.limit(0)
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert near_duplicates(none).count() == judge(none).count() == backoff_scores(none).count() == pack(none, public_tokenizers.path("byte_bpe_50k.json")).count() == 0
    assert classify_quality(none, labels).count() == classify_toxicity(none, labels).count() == 0
    assert windows(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    assert near_vectors(spark.createDataFrame([], "vec_id long, embedding array<float>, label int")).count() == 0


def test_edge_documents(spark, docs):
    labels = spark.createDataFrame([(4, 1, 0), (None, 0, 1), (5, None, None)], "doc_id long, quality int, toxic int")
    n = docs.count()
    q, t = classify_quality(docs, labels).collect(), classify_toxicity(docs, labels).collect()
    assert len(q) == len(t) == n and q[0].score == q[1].score == q[2].score == 0 and q[4].score == 0.5 and t[0].score == 0
    assert judge(docs).count() == n and backoff_scores(docs).count() == n
    near = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    assert near[4] == near[13] == 4 and near[0] == 0 and near[1] == 1
    kept = deduplicate(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 13").count() == 0


@pytest.mark.parametrize("op,label,fold,held", [(classify_quality, "quality", 4, 2), (classify_toxicity, "toxic", 5, 0)])
def test_held_out(spark, op, label, fold, held):
    sf = "/root/testdata/sf0.01"
    labels = table(spark, sf, "labels")
    rows = op(table(spark, sf, "documents"), labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % fold == held) for r in rows)
    out = [r for r in rows if r.held_out]
    assert sum(r.predicted == r[label] for r in out) >= 0.93 * len(out)


def test_shape_of_long_words():
    assert shape("a" * 64 + "##") != shape("a" * 70) and shape("a" * 5000) == "L"


@pytest.mark.parametrize("spare", [0, 50, 53])
def test_repeated_windows(spark, spare):
    """Also where so few bits of hashes are left that unlike windows share them."""
    rng = random.Random(21)
    texts = {k: " ".join(rng.choices("abcd", k=rng.choice([0, 1, 2, 3, 5, 9, 24]))) for k in range(60)} | {99: "w " * 300, 100: None}

    def repeats(x):
        w = (x or "").split()
        seen = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        return len({p for i in range(len(w) - 2) if seen[tuple(w[i : i + 3])] > 1 for p in (i, i + 1, i + 2)})

    got = measures(spark.createDataFrame([*texts.items()], "doc_id long, text string"), spare=spare).collect()
    assert {r.doc_id: r.n_repeat_words for r in got} == {k: repeats(x) for k, x in texts.items()}


def test_group_fences_move_smoothly(spark):
    """Own quartiles weigh n : PRIOR, without a step."""
    rng = random.Random(4)
    text = lambda n: " ".join("".join(rng.choices("abcdefgh", k=n)) for _ in range(60))
    rows = [(k, text(rng.randint(3, 6)), "en", "a") for k in range(600)] + [(1000 + k, text(12), "en", "b") for k in range(60)]
    bounds = []
    for n in (10, 30, 49, 50, 60):
        some = spark.createDataFrame([r for r in rows if r[0] < 1000 + n], "doc_id long, text string, lang string, source string")
        measured = measures(some).withColumn("base_failed", F.lit(False))
        bounds.append(fences(measured).where("source = 'b'").first().high_mean_chars)
    assert abs(bounds[3] - bounds[2]) < 200 < abs(bounds[-1] - bounds[0])


def test_grammar():
    g = Grammar({"zork*": 4.0}, 4.0)
    assert g.read["zorkish"][0] == INSULT
    plain, aimed, negated, reported = (g.evidence(x) for x in ("a zork here.", "you are a zork.", "he is not a zork.", "she said he is a zork."))
    assert aimed > plain > negated and reported < aimed and g.evidence("a fine day") == 0
    assert g.evidence("kill the process") == 0 < g.evidence("they will kill you; you will kill")


def links_of(texts, least, common=1 / 128):
    """Exact links (a, b) by weighted Jaccard similarity of TF-IDF shingles, and the smallest member of each one's component."""
    shingles = {}
    for k, x in texts.items():
        w = re.findall(r"[^\W_]+", (x or "").lower())
        shingles[k] = Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()
    share = Counter(g for c in shingles.values() for g in c)
    weight = {g: 1 + np.log(1 / min(1, max(common, n / len(texts)))) / np.log(1 / common) for g, n in share.items()}
    weighted = {k: {g: n * weight[g] for g, n in c.items()} for k, c in shingles.items()}
    total, holders = {k: sum(c.values()) for k, c in weighted.items()}, {}
    for k, c in weighted.items():
        for g in c:
            holders.setdefault(g, []).append(k)
    shared = Counter()
    for g, ks in holders.items():
        for i, a in enumerate(ks):
            for b in ks[i + 1 :]:
                shared[min(a, b), max(a, b)] += min(weighted[a][g], weighted[b][g])
    sims = {p: x / (total[p[0]] + total[p[1]] - x) for p, x in shared.items()}
    root = {k: k for k in texts}
    links = {p for p, x in sims.items() if x >= least}
    for _ in texts:
        moved = False
        for a, b in links:
            low = min(root[a], root[b])
            moved |= root[a] != low or root[b] != low
            root[a] = root[b] = low
        if not moved:
            break
    return sims, root


def near_copies(rng, groups=6, size=20, words=150):
    base = [[f"w{rng.randrange(400)}" for _ in range(words)] for _ in range(groups)]
    texts = {}
    for k in range(groups * size):
        w = list(base[k % groups])
        for _ in range(rng.choice([0, 0, 1, 1, 2, 3, 4, 6])):
            w[rng.randrange(len(w))] = f"edit{rng.randrange(40)}"
        texts[k] = " ".join(w)
    return texts


@pytest.mark.parametrize("rounds", [0, 1, 3])
def test_near_duplicates(spark, rounds):
    """Groups of near copies, some of whose edits agree: every component, whatever the number of rounds."""
    texts = near_copies(random.Random(5))
    _, want = links_of(texts, 0.8)
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame([*texts.items()], "doc_id long, text string"), rounds=rounds).collect()}
    assert len(set(want.values())) > 8 and sum(got[k] == want[k] for k in texts) >= 0.98 * len(texts)


def test_near_duplicate_recall(spark):
    """All documents of a table against all pairs: links of 0.8 and more are caught, and nothing else is joined."""
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    texts = {r.doc_id: r.text for r in docs.select("doc_id", "text").collect()}
    sims, want = links_of(texts, 0.8)
    got = {r.doc_id: r.class_id for r in near_duplicates(docs).collect()}
    sure = [p for p, x in sims.items() if x >= 0.8]
    assert len(sure) > 50 and sum(got[a] == got[b] for a, b in sure) >= 0.98 * len(sure)
    # weights come from counters, so a similarity near 0.8 may fall on the other side
    loose = links_of(texts, 0.79)[1]
    assert all(loose[k] == loose[got[k]] for k in texts)


def test_near_duplicates_that_share_an_id(spark):
    rng = random.Random(9)
    a, b, c = (" ".join(f"{x}{rng.randrange(90)}" for _ in range(60)) for x in "abc")
    rows = [(1, a, "x"), (1, b, "y"), (2, a, "z"), (3, b + " and more", "u"), (None, c, "v"), (None, c, "v"), (4, c, "w"), (5, None, None), (5, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, mark string").withColumnRenamed("mark", "id")
    kept = sorted((r.doc_id or 0, r.id or "") for r in deduplicate(docs).collect())
    assert kept == [(1, "x"), (1, "y"), (4, "w"), (5, ""), (5, "")]
    assert {r.class_id for r in near_duplicates(docs).collect() if r.doc_id in (None, 4)} == {4}


def test_vectors(spark):
    rng = np.random.default_rng(1)
    v = rng.standard_normal((300, 24))
    v[100:200] = v[:100] + 0.08 * rng.standard_normal((100, 24)) * rng.choice([1, 3], (100, 1))
    v[200:220] = v[0]
    rows = [(k, [float(x) for x in r], k % 3) for k, r in enumerate(v)] + [(900, None, 1), (901, [], 1), (902, [0.0] * 24, 1), (903, [float("nan")] * 24, 1), (904, [1.0] * 24, None), (905, [1.0, None], 1)]
    got = {r.vec_id: r for r in near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")).collect()}
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & (np.arange(300)[:, None] % 3 == np.arange(300) % 3)
    np.fill_diagonal(link, False)
    assert [got[k].n_links for k in range(300)] == link.sum(1).tolist()
    root = list(range(300))
    for _ in range(300):
        new = [min([root[k], *(root[j] for j in np.flatnonzero(link[k]))]) for k in range(300)]
        if new == root:
            break
        root = new
    assert [got[k].component_id for k in range(300)] == root
    assert all(got[k].n_links == 0 and got[k].kept for k in range(900, 906))


def test_vectors_of_any_length(spark):
    """Scaling changes no link, down to the least numbers and up to the largest; shared and null ids, and columns that clash."""
    rng = np.random.default_rng(2)
    v = rng.standard_normal((40, 16))
    v[20:] = v[:20] + 0.01 * rng.standard_normal((20, 16))
    v /= np.abs(v).max()
    scale = [1e-200, 1e-300, 1e308, 1e200, 1.0]
    rows = [(k, [float(x) for x in r * scale[k % 5]], 1, 7, 8) for k, r in enumerate(v)]
    rows += [(50, [1.0] * 16, 2, 0, 0), (50, [-1.0] * 16, 2, 0, 0), (51, [1.0] * 16, 2, 0, 0), (None, [-1.0] * 16, 2, 0, 0)]
    got = near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int, n int, cls int")).collect()
    by = {r.vec_id: r for r in got}
    assert all(by[k].n_links == 1 and by[k].component_id == k % 20 for k in range(40))
    assert sorted((r.vec_id or 0, r.n_links, r.component_id) for r in got if r.vec_id is None or r.vec_id >= 50) == [(0, 1, 50), (50, 1, 50), (50, 1, 50), (51, 1, 50)]


def test_vectors_in_tiles(spark):
    """Labels of many tiles, in single and double precision, tight and spread: as by brute force."""
    rng = np.random.default_rng(5)
    v = np.vstack([rng.standard_normal((260, 40)), rng.standard_normal(40) + 0.12 * rng.standard_normal((240, 40))]).astype(np.float32)
    v[200:260] = v[:60] + 0.2 * rng.standard_normal((60, 40)).astype(np.float32)
    v[250] = v[3]
    label = np.arange(500) % 7 // 3
    unit = v.astype(np.float64) / np.linalg.norm(v.astype(np.float64), axis=1, keepdims=True)
    link = (unit @ unit.T >= 0.93) & (label[:, None] == label)
    np.fill_diagonal(link, False)
    root = np.arange(500)
    while ((new := np.minimum(root, np.where(link, root, 500).min(axis=1))) != root).any():
        root = new
    assert 100 < link.sum() < 0.9 * link.size / 4
    for kind in ("float", "double"):
        df = spark.createDataFrame([(k, [float(x) for x in r], int(label[k])) for k, r in enumerate(v)], f"vec_id long, embedding array<{kind}>, label int")
        got = {r.vec_id: r for r in near_vectors(df, tile=30).collect()}
        assert [got[k].n_links for k in range(500)] == link.sum(axis=1).tolist()
        assert [got[k].component_id for k in range(500)] == root.tolist()


def test_vectors_on_disk(spark, tmp_path):
    """Vectors aren't copied for the pairs of tiles they take part in: what exchanges write follows the input."""
    rng = np.random.default_rng(6)
    sent = lambda: spark._jsc.sc().statusStore().executorList(False).apply(0).totalShuffleWrite()
    written = []
    for n in (1000, 4000):
        df = spark.createDataFrame([(k, r, 1) for k, r in enumerate(rng.standard_normal((n, 64)).tolist())], "vec_id long, embedding array<float>, label int")
        df.write.parquet(f"{tmp_path}/{n}")
        before = sent()
        near_vectors(spark.read.parquet(f"{tmp_path}/{n}")).count()
        written.append(sent() - before)
    assert written[1] < 4 * 4000 * 64 * 4


def test_vector_candidates(spark):
    """Few pairs are verified beyond the links."""
    vectors = table(spark, "/root/testdata/sf0.01", "embeddings")
    links = near_vectors(vectors).selectExpr("sum(n_links) div 2").first()[0]
    assert candidates(vectors) <= 2 * links + 100


def test_components(spark):
    edges = [(k, k + 1) for k in range(0, 40)] + [(100, 50), (100, 101), (7, 7)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert all(got[k] == 0 for k in range(41)) and got[101] == got[100] == got[50] == 50


def test_chat(spark):
    rows = [(1, 0, "system", "be brief"), (1, 1, "user", None), (1, 2, "assistant", "a\\</s>\n\\\\[INST] <|im_end|>"), (1, 3, "us\ner\\n", "x" * 10), (1, 3, "us\ner\\n", "x" * 10), (1, 4, None, "y"), (1, 5, "a\x00\\\\b", "z"), (1, 6, "\\", "")]
    rows += [(2, k, "user" if k % 2 == 0 else "assistant", f"turn {k} " + "word " * (40 * (k % 5))) for k in range(40)]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = windows(turns, budget=1500, history=300)
    assert out.where("conv_id = 2").count() > 3 and out.where("n_repeated > 0").count() > 0
    # the budget holds for whole windows, whose bytes bound their tokens, but for a turn that does not fit alone
    for r in out.selectExpr("*", "octet_length(formatted) as bytes").collect():
        assert r.bytes == r.n_tokens <= 1500
    tight = windows(turns, budget=400, history=100).selectExpr("*", "octet_length(formatted) as bytes").collect()
    assert all(r.bytes <= 400 or r.n_repeated == (r.conv_id == 1 and r.window > 0) and r.formatted.count("\n</s>\n") == 1 + r.n_repeated for r in tight)
    exact = turns.selectExpr("*", "10 as mine")
    assert windows(exact, budget=100, history=20, tokens="mine").selectExpr("max(n_tokens)").first()[0] <= 100
    back = {r.conv_id: r for r in read_back(out).collect()}
    for c in (1, 2):
        mine = sorted((x[1], x[2] or "", x[3] or "") for x in rows if x[0] == c)
        assert [(t.role, t.text) for t in back[c].turns] == [x[1:] for x in mine]
        assert list(back[c].targets) == [x[2] for x in mine if x[1] == "assistant"]


def test_packing(spark, docs):
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = pack(docs.dropDuplicates(["doc_id"]), public_tokenizers.path("byte_bpe_50k.json")).collect()
    pieces, sequences = {}, {}
    for r in rows:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for k, x in [*enumerate(TEXTS), (99, "one two")]:
        ids = [*library.encode(x or "", add_special_tokens=False).ids, 0]
        got = sorted(pieces[k], key=lambda r: r.start)
        assert b"".join(bytes(r.ids) for r in got) == struct.pack(f"<{len(ids)}I", *ids) and all(r.doc_tokens == len(ids) for r in got)
    for parts in sequences.values():
        at = 0
        for r in sorted(parts, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= 1024 and len(parts) <= 64 and at & (at - 1) == 0


def test_packing_ids(hostile):
    """The merging engine against the vocabulary's own library."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    own, library = encoding(path), Tokenizer.from_file(path)
    rng = random.Random(8)
    texts = [*hostile, "<|endoftext|>a <|endoftext|> <|endoftext|", *("".join(chr(rng.choice([rng.randrange(32, 0x250), rng.randrange(0x250, 0xD7FF), rng.randrange(0x10000, 0x10FFFF)])) for _ in range(20)) for _ in range(1500))]
    for x in texts:
        assert own.encode(x, allowed_special="all") == library.encode(x, add_special_tokens=False).ids, x


@pytest.mark.parametrize("limits", [Limits(64, 3, 20), Limits(64, 8, 64), Limits(16, 1, 16)])
def test_vector_limits(limits):
    rng = random.Random(2)
    p = Packer(limits, 0)
    for k in range(200):
        n = rng.randint(1, 60)
        mask = [rng.random() < 0.3 for _ in range(n)]
        p.add((k, 0, np.arange(n, dtype=np.uint32), np.concatenate([[0], np.cumsum(mask)])))
    p.drain(0)
    tokens, segments, loss, seen = Counter(), Counter(), Counter(), Counter()
    for key, start, ids, sequence, offset in p.out:
        tokens[sequence] += len(ids)
        segments[sequence] += 1
        seen[key] += len(ids)
    assert max(tokens.values()) <= limits.tokens and max(segments.values()) <= limits.segments and len(seen) == 200


def test_pipeline(spark):
    import corpus_pipeline as c

    sf = "/root/testdata/sf0.01"
    docs = table(spark, sf, "documents")
    labels = {r.doc_id: r for r in table(spark, sf, "labels").collect()}
    clean = c.keep_quality(spark, docs, sf)
    assert clean.columns == docs.columns
    kept = {r.doc_id for r in clean.select("doc_id").collect()}
    assert sum(labels[k].quality == (k in kept) for k in labels) >= 0.97 * len(labels)
    calm = {r.doc_id for r in c.drop_toxic(spark, docs, sf).select("doc_id").collect()}
    assert sum(labels[k].toxic != (k in calm) for k in labels) >= 0.93 * len(labels)
    one = c.drop_near_duplicates(spark, docs, sf)
    texts = [r.text for r in one.collect() if r.text]
    assert one.columns == docs.columns and len(texts) == len(set(texts))
    packed = {r.doc_id for r in c.run(spark, sf).select("doc_id").distinct().collect()}
    assert packed <= kept and len(packed - calm) <= 0.03 * len(packed)  # its grammar is learned from what quality kept


def test_pipeline_cases(spark, docs, tmp_path):
    """Each stage alone over null, empty, repeated and odd rows, with columns that clash, and over an empty table."""
    import corpus_pipeline as c

    spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    odd = docs.unionByName(spark.createDataFrame([(None, "word", None, None, None, None), (12, "another text under the same id", "en", "s", 1, "x")], docs.schema)).withColumnsRenamed({"score": "cls", "n_tokens": "mark"})
    for name, stage in c.STAGES[:-1]:
        out = stage(spark, odd, str(tmp_path))
        assert out.columns == odd.columns and stage(spark, odd.limit(0), str(tmp_path)).count() == 0, name
    one = c.drop_near_duplicates(spark, odd, str(tmp_path))
    assert one.where("doc_id = 12").count() == 2 and one.where("text = 'word'").count() == 2 and one.where("text is null").count() == 1
    packed = c.pack_sequences(spark, odd, str(tmp_path))
    assert packed.where("doc_id = 0").select("length", "doc_tokens").collect() == [(1, 1)] and packed.where("doc_id is null").count() >= 1
    assert c.pack_sequences(spark, odd.limit(0), str(tmp_path)).count() == 0


def test_votes_by_brute_force(spark):
    """Scores against one document at a time, in double precision, with a full sort."""
    sf = "/root/testdata/sf0.001"
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    model = fit_quality(sample(docs, labels, "quality", 4, 2, {0: 2000, 1: 2000}))
    got = {r.doc_id: r.score for r in classify_quality(docs, labels).collect()}
    for r in docs.collect():
        f = features(r.text).astype(np.float64) * model.weights
        if not f.any():
            assert got[r.doc_id] == 0
            continue
        v = (f / np.linalg.norm(f)) @ model.projection.astype(np.float64)
        cosines = model.vectors.astype(np.float64) @ (v / np.linalg.norm(v))
        last = sorted(cosines)[-min(15, len(cosines))]
        votes = [(max(x, 1e-6) ** 4, y) for x, y in zip(cosines, model.labels) if x >= last - 1e-6]
        assert got[r.doc_id] == pytest.approx(sum(w * y for w, y in votes) / sum(w for w, _ in votes), abs=0.08)


def test_grammar_by_brute_force(spark):
    """The composed machine against its transducers run one after the other over each clause."""
    sf = "/root/testdata/sf0.001"
    docs = table(spark, sf, "documents")
    machine = fit_toxicity(docs, table(spark, sf, "labels"))
    scores = {r.doc_id: r.score for r in classify_toxicity(docs, table(spark, sf, "labels")).collect()}

    def evidence(text):
        total = 0.0
        for clause in re.split(r"[.!?;:\n]+", (text or "").lower()):
            words = re.findall(r"[^\W_]+(?:'[^\W_]+)?", clause)
            best, since = 0.0, {3: 99, 4: 99, 5: 99}
            for w in words:
                kind, weight = machine._read(w)
                if kind in (1, 2) and not (kind == 2 and since[3] >= 5):
                    best = max(best, weight * (1.25 if since[3] < 5 else 1) * (0.4 if since[4] < 3 else 1) * (0.6 if since[5] < 8 else 1))
                since = {k: 0 if kind == k else n + 1 for k, n in since.items()}
            total += best
        return total

    for r in docs.collect():
        assert scores[r.doc_id] == pytest.approx(1 - 2 ** (-evidence(r.text) / machine.bar), abs=1e-9)


def test_words_in_runs(monkeypatch, hostile):
    """Texts longer than a run are cut between words, so that nothing changes."""
    for kind in ("letters", "blanks"):
        whole = words.word_hashes([*hostile, None], kind)
        monkeypatch.setattr(words, "RUN", 37)
        cut = words.word_hashes([*hostile, None], kind)
        monkeypatch.undo()
        assert (whole[0] == cut[0]).all() and (whole[1] == cut[1]).all()
    assert words.word_hashes([None, ""])[1].tolist() == [0, 0]
    pattern = re.compile(r"[^\W_]+")
    hashes, counts = words.word_hashes(hostile)
    flat = [w for x in hostile for w in pattern.findall(x.lower())]
    assert len(set(zip(flat, hashes.tolist()))) == len(set(flat)) == len(set(hashes.tolist()))


def test_very_long_texts(spark):
    """One text beyond the runs in which texts are handed on, between small ones."""
    rng = random.Random(12)
    long = " ".join(f"w{rng.randrange(5000)}" for _ in range(700_000))
    docs = spark.createDataFrame([(1, "short one"), (2, long), (3, long + " end"), (4, None)], "doc_id long, text string")
    assert len(long) > 4_000_000
    assert {r.doc_id: r.class_id for r in near_duplicates(docs).collect()} == {1: 1, 2: 2, 3: 2, 4: 4}
    assert {r.doc_id: r.n_words for r in backoff_scores(docs).collect()} == {1: 2, 2: 700_000, 3: 700_001, 4: 0}
    assert sum(r.length for r in pack(docs, public_tokenizers.path("byte_bpe_50k.json")).where("doc_id = 2").collect()) > 700_000


def test_digests(spark):
    rows = {r.doc_id: r for r in queries.QUERIES["op9_sentencepiece"](spark, DATA).collect()}
    library = sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))
    for r in table(spark, DATA, "documents").limit(40).collect():
        ids = library.encode(r.text)
        assert rows[r.doc_id].n_tokens == len(ids)
        assert rows[r.doc_id].ids_sha256 == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert rows[r.doc_id].decoded_sha256 == hashlib.sha256(library.decode(ids).encode()).hexdigest()


@pytest.mark.parametrize("order,others", [(1, True), (2, False), (3, True), (3, False), (4, True)])
def test_backoff_orders(spark, order, others):
    rng = random.Random(7)
    texts = {k: " ".join(rng.choices("abcdef", k=rng.choice([0, 1, 2, 3, 30]))) for k in range(40)} | {41: "unheard of", 42: None}
    words = {k: (x or "").split() for k, x in texts.items()}
    grams = lambda w: Counter(tuple(w[i : i + n]) for n in range(1, order + 1) for i in range(len(w) - n + 1))
    held, total = sum(map(grams, words.values()), Counter()), sum(map(len, words.values()))

    def score(gram, held, total):
        if held[gram]:
            return np.log(held[gram] / (held[gram[:-1]] if len(gram) > 1 else total))
        return np.log(0.4) + (score(gram[1:], held, total) if len(gram) > 1 else -np.log(total))

    rows = [*texts.items(), (None, texts[0]), (7, texts[7])]
    held += grams(words[0]) + grams(words[7])
    total += len(words[0]) + len(words[7])
    got = [(r.doc_id, r.n_words, r.score) for r in backoff_scores(spark.createDataFrame(rows, "doc_id long, text string"), order=order, others=others).collect()]
    assert sorted(str(k) for k, _, _ in got) == sorted(str(k) for k, _ in rows)
    for k, n, x in got:
        w = words[0 if k is None else k]
        mine, rest = (held - grams(w), max(1, total - len(w))) if others else (held, total)
        assert n == len(w) and x == pytest.approx(sum(score(tuple(w[max(0, i - order + 1) : i + 1]), mine, rest) for i in range(len(w))))


def test_backoff_blocks(spark):
    """Documents of many batches share a block, which takes less room than the hashes of its words."""
    rng = random.Random(8)
    known = ["".join(rng.choices("abcdefghij", k=6)) for _ in range(20_000)]
    texts = {k: " ".join(rng.choices(known, k=100)) for k in range(5000)} | {5000: None, 5001: "é日\n😀 \ud7ff", 5002: ""}
    docs = spark.createDataFrame([*texts.items()], "doc_id long, text string").repartition(1)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    blocks = exploded(docs, "doc_id", "text").selectExpr("size(keys) as n", "octet_length(lengths) + octet_length(texts) as bytes").collect()
    assert [b.n for b in blocks] == [5003] and blocks[0].bytes < 500_000 * 4


@pytest.mark.parametrize("limits", [Limits(64, 3, 20), Limits(64, 8, 5)])
def test_packer_loss_limit(limits):
    rng = random.Random(2)
    p, masks, loss = Packer(limits, 0), {}, Counter()
    for k in range(200):
        masks[k] = np.array([rng.random() < 0.5 for _ in range(rng.randint(1, 60))])
        p.add((k, 0, np.arange(len(masks[k]), dtype=np.uint32), np.concatenate([[0], np.cumsum(masks[k])])))
    p.drain(0)
    for key, start, ids, sequence, _ in p.out:
        loss[sequence] += int(masks[key][start : start + len(ids)].sum())
    assert max(loss.values()) == limits.loss and sum(loss.values()) == sum(int(m.sum()) for m in masks.values())


@pytest.mark.parametrize("limits", [Limits(64, 8, 20), Limits(64, 8, 64)])
def test_pack_masked_prompts(spark, limits):
    turns = [(c, k, "user" if k % 2 == 0 else "assistant", f"日本 é turn {k} " + "word " * (7 * (c + k) % 90)) for c in range(30) for k in range(4)]
    chats = windows(spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")).where("window = 0").cache()
    extra = spark.createDataFrame([(100, "all of it", None), (101, "none of it", []), (102, "", []), (103, None, None), (104, "beyond", [(3, 1000)])], "conv_id long, formatted string, loss array<struct<start: int, length: int>>")
    source = chats.select("conv_id", "formatted", "loss").union(extra)
    rows = pack(source, public_tokenizers.path("byte_bpe_50k.json"), limits, "conv_id", "formatted", loss="loss").collect()
    library = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    loss, pieces = Counter(), {}
    for r in rows:
        assert len(r.loss_mask) == r.length and sum(r.loss_mask) == r.loss_tokens
        loss[r.sequence_id] += r.loss_tokens
        pieces.setdefault(r.conv_id, []).append(r)
    assert 0 < max(loss.values()) <= limits.loss
    for c in source.collect():
        text, got = c.formatted or "", sorted(pieces[c.conv_id], key=lambda r: r.start)
        code = library.encode(text, add_special_tokens=False)
        spans = [(0, len(text))] if c.loss is None else [(s.start - 1, s.start - 1 + s.length) for s in c.loss]
        want = [any(a < hi and b > lo for lo, hi in spans) for a, b in code.offsets]
        assert b"".join(bytes(r.ids) for r in got) == struct.pack(f"<{len(code.ids) + 1}I", *code.ids, 0)
        assert [bool(b) for r in got for b in r.loss_mask] == [*want, want[-1] if want else c.loss is None]


def test_near_duplicates_of_heavy_shingles(spark):
    """Pairs of long texts that share one line repeated thousands of times, and nothing else."""
    rows = [(k, " ".join([f"line{k // 2}"] * 3000 + [f"own{k}x{j}" for j in range(300)])) for k in range(20)]
    got = {r.doc_id: r.class_id for r in near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {k: k - k % 2 for k in range(20)}
