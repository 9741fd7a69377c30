import hashlib
import math
import random
import re
import tracemalloc
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from lodestone.llm import decontam, graph, interpolation, jaccard, langid, repeats, sharding, tokens, toxicity
from lodestone.llm.queries import queries
from lodestone.llm.textbytes import column_bytes
from tests.llm.common import ROWS, docs, table

SF = "/root/testdata/sf0.001"


# -- 6: sharding


def test_hypergeometric_draws_follow_the_law(spark):
    n = 20_000
    x = spark.range(n).select(F.expr(sharding.hypergeometric_sql("50L", "20L", "13L", f"(id + 0.5D) / {n}D")).alias("x"))
    got = Counter(r["x"] for r in x.collect())
    for k in range(14):
        assert abs(got[k] / n - math.comb(20, k) * math.comb(30, 13 - k) / math.comb(50, 13)) < 2e-4


def test_matrix_has_exact_sums(spark):
    counts = spark.createDataFrame([(i, i * i % 13) for i in range(64) if i % 5], "part long, n long")
    rows = sharding.communication_matrix(counts, 7, 6, 1).collect()
    assert {r["part"]: sum(r["take"]) for r in rows if sum(r["take"])} == {r["part"]: r["n"] for r in counts.collect() if r["n"]}
    total = [sum(r["take"][s] for r in rows) for s in range(7)]
    assert max(total) - min(total) <= 1 and all(min(r["take"]) >= 0 for r in rows)


def test_shards_are_exact_and_uniform(spark):
    out = sharding.uniform_shards(spark.range(6000).withColumn("shard", F.lit("clash")), 24).collect()
    by = defaultdict(list)
    for r in out:
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(24)) and all(sorted(v) == list(range(250)) for v in by.values())
    # neighbours in the input part as chance has it, and slots don't follow the input
    shard = {r["id"]: r["shard"] for r in out}
    assert 150 < sum(shard[i] == shard[i + 1] for i in range(5999)) < 350
    assert abs(np.corrcoef([r["id"] for r in out], [r["slot"] for r in out])[0, 1]) < 0.06


def test_sharding_keeps_columns_of_any_name(spark):
    df = spark.range(500).selectExpr("id", "id as _hg_part", "id as _HG_rank", "id as _hg_ends", "id as n", "id as take", "id as part", "id as level")
    out = sharding.uniform_shards(df, 7)
    assert out.columns == [*df.columns, "shard", "slot"] and out.where("_hg_part = id and _HG_rank = id and part = id").count() == 500


def test_shards_are_written_in_order(spark, tmp_path):
    out = sharding.uniform_shards(spark.range(5000), 5)
    sharding.write_shards(out, f"{tmp_path}/s", 4)
    for k in range(5):
        files = sorted((tmp_path / "s" / f"shard={k}").glob("part-*"))
        slots = [v for f in files for v in pq.read_table(f, partitioning=None).column("slot").to_pylist()]
        assert len(files) > 1 and slots == list(range(1000))


def test_sharding_of_odd_rows(spark):
    assert sharding.uniform_shards(docs(spark), 4).groupBy("shard").count().agg(F.max("count") - F.min("count")).first()[0] <= 1
    assert sharding.uniform_shards(docs(spark, []), 4).count() == 0


# -- 8: repeats


def brute_repeats(rows, length=100):
    seen, out = set(), {}
    for i, t in sorted(rows):
        b = t.encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if b[p : p + length] in seen:
                gone[p : p + length] = True
            seen.add(b[p : p + length])
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[i] = (len(b), int(gone.sum()), int((np.diff(np.r_[0, gone.astype(int)]) == 1).sum()), kept)
    return out


@pytest.mark.parametrize("hot", [400, 3])
def test_repeats_against_brute_force(spark, monkeypatch, hot):
    monkeypatch.setattr(repeats, "HOT", hot)
    r = random.Random(1)
    base = "".join(r.choice("abc ") for _ in range(2000))
    rows = []
    for i in range(60):
        a, b = r.randint(0, 1500), r.randint(1, 400)
        rows.append((i, "".join(r.choice("abé") for _ in range(r.randint(0, 150))) + base[a : a + b] + "x" * r.choice([0, 0, 300]) + "ab" * r.choice([0, 100]) + base[a // 2 : a // 2 + 130]))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = repeats.remove_repeats(df, 100, block_bytes=20_000).collect()
    assert {x["doc_id"]: (x["n_bytes"], sum(s["end"] - s["start"] for s in x["spans"]), len(x["spans"]), bytes(x["kept"])) for x in got} == brute_repeats(rows)


def test_anchors_are_the_same_by_runs(monkeypatch):
    rng = random.Random(3)
    texts = ["", "a" * 3000, *["".join(rng.choices("abcd ", k=rng.choice([0, 60, 99, 100, 101, 700]))) for _ in range(200)]]
    buf, bounds = column_bytes(pa.array(texts))
    want = repeats.anchors(buf, bounds, 100)
    for run in (1, 150, 5000):
        monkeypatch.setattr(repeats, "RUN", run)
        starts = [{int(p) for a, b in zip(lo, hi, strict=True) for p in range(a, b + 1)} for _, lo, hi in (want, repeats.anchors_by_runs(buf, bounds, 100))]
        assert starts[0] == starts[1] == {p for a, b in zip(bounds[:-1], bounds[1:], strict=True) for p in range(a, b - 99)}
        assert all((x == y).all() for x, y in zip(want, repeats.anchors_by_runs(buf, bounds, 100), strict=True))


def test_blocks_take_little_memory_and_let_tokenizers_go(monkeypatch):
    class Here:
        def mapInArrow(self, run, schema):
            return run

    class Task:
        get = staticmethod(lambda: Task)
        partitionId = staticmethod(lambda: 0)

    monkeypatch.setattr(repeats, "TaskContext", Task)
    monkeypatch.setitem(tokens._loaded, "kept by an earlier stage", None)
    rng = np.random.default_rng(1)
    texts = [rng.integers(97, 123, 4000, np.uint8).tobytes().decode() for _ in range(600)]
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array(range(600), pa.int64()), "text": texts})
    run = repeats.blocks(Here(), 100, 2 << 20)
    tracemalloc.start()
    assert sum(b.num_rows for b in run(iter([batch]))) == 2
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 80 << 20 and not tokens._loaded


def test_repeats_of_odd_rows(spark):
    df = docs(spark).withColumn("spans", F.lit("clash"))
    got = repeats.remove_repeats(df, 100).collect()
    assert len(got) == len(ROWS) and {r["lang"] for r in got} == {x[2] for x in ROWS}
    assert all(bytes(r["kept"]).decode("utf-8", "ignore") == r["text"] for r in got)
    assert repeats.remove_repeats(docs(spark, []), 100).count() == 0


# -- 5: similarity join


def words_of(text):
    return tuple(re.findall(rb"[0-9A-Za-z\x80-\xff]+", (text or "").encode().lower()))


def brute_join(rows):
    classes = defaultdict(list)
    for i, t in rows:
        classes[words_of(t)].append(i)
    reps = [(min(v), {w[k : k + 5] for k in range(max(1, len(w) - 4))}) for w, v in classes.items() if w]
    parent, links = {i: i for i, _ in reps}, Counter()

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, (i, s) in enumerate(reps):
        for j, t in reps[:a]:
            if len(s & t) >= 0.8 * len(s | t):
                links[i] += 1
                links[j] += 1
                x, y = root(i), root(j)
                parent[max(x, y)] = min(x, y)
    out = {}
    for w, ids in classes.items():
        for i in ids:
            out[i] = (root(min(ids)), min(ids), links[min(ids)], len(ids)) if w else (i, i, 0, 1)
    return out


@pytest.mark.parametrize(("chunk", "classes"), [(500_000, 1024), (400, 1024), (500_000, 3)])
def test_join_against_brute_force(spark, chunk, classes):
    r = random.Random(2)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(5))
    rows = []
    for g in range(12):
        base = [word() for _ in range(r.randint(3, 80))]
        for _ in range(r.choice([1, 2, 15])):
            own = list(base)
            for _ in range(r.randint(0, 3)):
                own[r.randrange(len(own))] = word()
            rows.append((len(rows), " ".join(own)))
    rows += [(len(rows) + k, t) for k, t in enumerate(["", "?", "one two", "One, two!"])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {x["doc_id"]: (x["class_id"], x["text_id"], x["n_links"], x["n_copies"]) for x in jaccard.join(df, chunk_grams=chunk, chunk_classes=classes).collect()}
    assert got == brute_join(rows)


def test_join_of_a_chain(spark, monkeypatch):
    """Texts that share half of their n-grams with the next ones: bands join them all, yet few sets are sent."""
    words = [f"w{i}" for i in range(2000)]
    rows = [(i, " ".join(words[10 * i : 10 * i + 34])) for i in range(190)] + [(500, " ".join(words[300:334])), (501, " ".join([*words[300:333], "z"]))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sent = []
    monkeypatch.setattr(jaccard, "written", lambda d, name, put=jaccard.written: sent.append((name, put(d, name))) or sent[-1][1])
    got = {x["doc_id"]: (x["class_id"], x["text_id"], x["n_links"], x["n_copies"]) for x in jaccard.join(df).collect()}
    assert got == brute_join(rows) and got[501][0] == 30
    member = next(d for name, d in sent if name == "members")
    assert member.groupBy("value").count().agg(F.max("count")).first()[0] < 12  # buckets of neighbours, never the chain


def test_join_of_many_short_texts(spark):
    """20,000 texts of six words each, so two n-grams; chunks are bounded in classes."""
    df = spark.range(20_000).selectExpr("id as doc_id", "concat('one two three four five ', if(id % 2 = 0, id, id - 1), if(id % 2 = 0, '', '!')) as text")
    got = jaccard.join(df).groupBy("class_id").agg(F.count(F.lit(1)).alias("n"), F.max("n_links").alias("l"), F.max("n_copies").alias("c")).collect()
    assert len(got) == 10_000 and all((r["n"], r["l"], r["c"]) == (2, 0, 2) for r in got)


def test_recall_at_the_threshold(spark):
    """Every one of 400 pairs whose similarity is 0.8 to 0.82 is found."""
    r = random.Random(9)
    rows = []
    for g in range(400):
        w = [f"{g}x{r.random()}" for _ in range(104)]
        own = list(w)
        for k in (30, 60):
            own[k] = "changed"
        own = own[:100]
        a, b = ({tuple(x[k : k + 5]) for k in range(len(x) - 4)} for x in (w[:100], own))
        assert 0.8 < len(a & b) / len(a | b) < 0.82
        rows += [(2 * g, " ".join(w[:100])), (2 * g + 1, " ".join(own))]
    got = {x["doc_id"]: x["class_id"] for x in jaccard.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {i: i - i % 2 for i in range(800)}


def test_one_of_each_group(spark):
    text = " ".join(f"w{i}" for i in range(60))
    near = text + " more"
    rows = [(1, "unique text one here", "a"), (1, text, "b"), (2, text, "c"), (2, text, "c"), (None, text, "d"), (None, near, "e"), (7, near.upper(), "f"), (8, "", "g"), (8, "", "g"), (None, None, "h"), (9, "?!", "i"), (None, "null ids only", "j"), (None, "Null ids, only!", "k")]
    df = spark.createDataFrame(rows, "doc_id long, text string, `key` string")
    got = sorted((str(r["doc_id"]), r["key"]) for r in jaccard.keep_one(df).collect())
    assert [x for x in got if x[1] not in "jk"] == sorted([("1", "a"), ("1", "b"), ("8", "g"), ("8", "g"), ("None", "h"), ("9", "i")])
    assert len([x for x in got if x[1] in "jk"]) == 1
    assert jaccard.keep_one(df.limit(0)).count() == 0 and jaccard.keep_one(df).columns == df.columns


def test_join_of_odd_rows(spark):
    got = jaccard.join(docs(spark)).collect()
    assert len(got) == len(ROWS)
    by = {r["doc_id"]: r for r in got}
    assert by[5]["class_id"] == 1 and by[2]["class_id"] == 2 and by[3]["class_id"] == 3
    assert jaccard.join(docs(spark, [])).count() == 0


def test_bands_reach_the_recall():
    bands, rows = jaccard.choose_bands(0.8, 0.99999)
    assert 1 - (1 - 0.8**rows) ** bands >= 0.99999 and bands * rows <= 240


def test_components(spark):
    path = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (102, 100), (7, 7)]
    got = {r["node"]: r["root"] for r in graph.components(spark.createDataFrame(path, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {101: 100, 102: 100}


# -- 3: decontamination


def test_wand_finds_all_above_the_threshold():
    for seed in range(30):
        r = random.Random(seed)
        vocabulary = [f"w{i}" for i in range(60)]
        items = [" ".join(r.choice(vocabulary) for _ in range(r.randint(3, 30))) for _ in range(r.randint(1, 200))]
        ix = decontam.Index(list(range(len(items))), items, block=r.choice([1, 3, 32]), least_words=1)
        for _ in range(10):
            terms = sorted({int(t) for t in ix.find(decontam._word_hashes([" ".join(r.sample(vocabulary, r.randint(1, 30)))])[0]) if t >= 0})
            least, score = r.choice([0.1, 0.3, 0.5, 0.7]), Counter()
            for t in terms:
                own = slice(ix.bounds[t], ix.bounds[t + 1])
                for i, w in zip(ix.items[own].tolist(), ix.weights[own].tolist(), strict=True):
                    score[i] += w
            assert sorted(i for i, v in ix.search(terms, least) if v >= least + 1e-9) == sorted(i for i, v in score.items() if v >= least + 1e-9)


def test_leaks(spark):
    item = "What colour is the sky over the northern sea at noon? It is a pale grey with some green."
    question, answer = decontam.split_item(item)
    filler = " ".join(f"filler{i}" for i in range(300))
    rows = [(1, f"{filler} {item.upper()} {filler}"), (2, f"{filler} {question}"), (3, f"{answer} {filler}"), (4, None), (None, item), (6, "")]
    bench = spark.createDataFrame([(9, item), (10, None), (11, "")], "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("leaks", F.lit("clash"))
    for size in (32 << 20, 10):  # in one pass, and in several
        got = {r["doc_id"]: [x["item_id"] for x in r["leaks"]] for r in decontam.find_leaks(df, bench, index_bytes=size).collect()}
        assert got == {1: [9], 2: [], 3: [], 4: [], None: [9], 6: []}
    assert decontam.find_leaks(df.limit(0), bench).count() == 0
    assert decontam.find_leaks(df, bench.limit(0)).where(F.size("leaks") > 0).count() == 0


def test_parts_of_a_benchmark_share_their_statistics(spark):
    """Leaks and scores are those of one index, whatever the number of parts, and those of a plain program."""
    r = random.Random(6)
    word = lambda: f"w{int(r.expovariate(0.02))}"
    items = [" ".join(word() for _ in range(r.randint(3, 60))) + "? " + " ".join(word() for _ in range(r.randint(1, 30))) + "." for _ in range(200)]
    rows = []
    for i in range(60):
        t = r.choice(items).split() + [word() for _ in range(r.choice([0, 40]))]
        for _ in range(r.choice([0, 0, 1, 4])):
            t[r.randrange(len(t))] = word()
        rows.append((i, " ".join([word() for _ in range(r.choice([0, 90]))] + t)))
    bench = spark.createDataFrame(list(enumerate(items)), "item_id long, text string")
    df = spark.createDataFrame(rows, "doc_id long, text string")
    size = sum(len(t.encode()) for t in items)
    got = [
        {(x["doc_id"], k["item_id"]): (round(k["score"], 9), k["question_overlap"], k["answer_overlap"]) for x in decontam.find_leaks(df, bench, index_bytes=b).collect() for k in x["leaks"]}
        for b in (size, size // 5 + 1)
    ]
    assert got[0] == got[1] and len(got[0]) > 30

    words = lambda t: re.findall("[0-9a-z]+", t)
    split = [[words(x) for x in decontam.split_item(t)] for t in items]
    seen = Counter(w for t in split for w in set(t[0] + t[1]))
    mean = sum(len(q) + len(a) for q, a in split) / 200
    want = {}
    longest = max(len(q) + len(a) for q, a in split)
    for i, t in rows:
        t = words(t)
        for k, parts in enumerate(split):
            tf = Counter(parts[0] + parts[1])
            n = sum(tf.values())
            if n < 8:
                continue
            weight = {w: math.log(1 + (200 - seen[w] + 0.5) / (seen[w] + 0.5)) * c * 2.2 / (c + 1.2 * (0.25 + 0.75 * n / mean)) for w, c in tf.items()}
            size_ = max(64, 2 * longest)
            for at in range(0, max(1, len(t) - size_ + size_ // 2), size_ // 2):
                passage = t[at : at + size_]
                score = sum(weight[w] for w in set(passage) if w in weight) / sum(weight.values())
                held = []
                for part in parts:
                    z = min(5, len(part))
                    own = {tuple(part[j : j + z]) for j in range(len(part) - z + 1)} if z else set()
                    there = {tuple(passage[j : j + z]) for j in range(len(passage) - z + 1)}
                    share = len(own & there) / len(own) if own else 1.0
                    if len(own) < 25 and share < 1:
                        for d in range(-len(part), len(passage)):
                            step = sum(any(0 <= j + e < len(passage) and passage[j + e] == w for e in (d, d - 1)) for j, w in enumerate(part))
                            share = max(share, step / len(part))
                    held.append(share)
                if score >= 0.5 and min(held) >= 0.8:
                    want[i, k] = max((round(score, 9), *held), want.get((i, k), (-1,)))
    assert got[0] == want


def test_short_items_leak_nothing(spark):
    bench = spark.createDataFrame([(1, "Yes"), (2, "No it is not.")], "item_id long, text string")
    df = spark.createDataFrame([(1, "Yes, of course. No it is not. " * 9)], "doc_id long, text string")
    assert decontam.find_leaks(df, bench).first()["leaks"] == []
    assert len(decontam.find_leaks(df, bench, least_words=1).first()["leaks"]) == 2


def test_leaks_in_the_tables(spark):
    got = {(r["doc_id"], r["item_id"]) for r in queries()["op3_decontamination"](spark, SF).collect()}
    items = table(SF, "benchmark")
    assert got >= {(d["doc_id"], i["item_id"]) for d in table(SF, "documents") for i in items if i["text"] in d["text"]}


# -- 4: language model


def test_scores_against_direct_counts(spark):
    got = {r["doc_id"]: r for r in queries()["op4_interpolation"](spark, SF).collect()}
    low = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))
    toks = {d["doc_id"]: [*re.findall(rb"[^\x20\x09-\x0D]+", d["text"].encode().translate(low)), None] for d in table(SF, "documents")}
    c = Counter(w for i, t in toks.items() if zlib.crc32(str(i).encode()) % 7 != 2 for w in t)
    n, v = sum(c.values()), len(c)
    base = score = 0.0
    for i, t in toks.items():
        want = sum(math.log10((c[w] + 1) / (n + v + 1)) for w in t)
        r = got[i]
        assert (r["train_tokens"], r["n_tokens"], r["n_known"], r["held_out"]) == (n, len(t), sum(c[w] > 0 for w in t), zlib.crc32(str(i).encode()) % 7 == 2)
        assert abs(r["base_score"] - want) < 1e-6 * abs(want)
        if r["held_out"]:
            base, score = base + r["base_score"], score + r["score"]
    assert score > base


def test_model_is_a_distribution(spark):
    """Over a small vocabulary, the probabilities of all one-word continuations add up to one."""
    r = random.Random(4)
    rows = [(i, " ".join(r.choice("abcdef") for _ in range(r.randint(0, 8))), True) for i in range(80)]
    asked = [(1000 + k, w, False) for k, w in enumerate(["", *"abcdef", "zz"])]
    df = spark.createDataFrame(rows + asked, "doc_id long, text string, train boolean")
    got = {x["doc_id"]: x["score"] for x in interpolation.score(df).collect()}
    # P(w, end) <= P(w): the first words' probabilities and the empty text's leave at most one
    assert sum(10 ** got[1000 + k] for k in range(8)) < 1 and len(got) == 88


def test_weights_by_expectation_maximisation():
    # events that the pair estimate explains well must give it the weight
    p = np.array([0.5, 1e-3]), np.array([1e-3, 1e-3])
    w = interpolation.learn_weights(np.array([3, 3]), *p, np.array([99, 1]), 1000)
    assert w[3, 0] > 0.9 and abs(w.sum(1) - 1).max() < 1e-9 and w[0, 0] == 0


def test_model_of_order_three(spark, monkeypatch):
    """With fixed weights every score is the one by counts of words, pairs and triples; the triple decides where the pair can't."""
    r = random.Random(3)
    rows = [(i, " ".join(r.choice(["a x c", "b x d", "a", "x d"]) for _ in range(r.randint(0, 5))), True) for i in range(300)]
    asked = [(1000, "a x c", False), (1001, "a x d", False), (1002, "zz a x c", False)]
    df = spark.createDataFrame(rows + asked, "doc_id long, text string, train boolean")
    got = {x["doc_id"]: x["score"] for x in interpolation.score(df, block_bytes=2000).collect()}
    assert got[1000] > got[1001] + 0.2
    monkeypatch.setattr(interpolation, "learn_weights", lambda *a: np.array([[0, 0.6, 0.4]] + [[0.5, 0.3, 0.2]] * 63))
    monkeypatch.setattr(interpolation, "learn_shares", lambda *a: np.array([[0, 1]] + [[0.7, 0.3]] * 63))
    got = {x["doc_id"]: x["score"] for x in interpolation.score(df, block_bytes=2000).collect()}
    toks = {i: ["<s>", "<s>", *t.split(), None] for i, t, _ in rows + asked}
    uni, bi, tri, one, two = (Counter() for _ in range(5))
    for i, _, train in rows + asked:
        for u, v, w in zip(toks[i], toks[i][1:], toks[i][2:], strict=False) if train else ():
            uni[w] += 1
            bi[v, w] += 1
            tri[u, v, w] += 1
            one[v] += 1
            two[u, v] += 1
    n, types = sum(uni.values()), len(uni)
    for i, t in toks.items():
        want = 0.0
        for u, v, w in zip(t, t[1:], t[2:], strict=False):
            p = 0.5 * bi[v, w] / one[v] + 0.3 * uni[w] / n + 0.2 / (types + 1) if one[v] else 0.6 * uni[w] / n + 0.4 / (types + 1)
            want += math.log10(0.7 * tri[u, v, w] / two[u, v] + 0.3 * p if two[u, v] else p)
        assert abs(got[i] - want) < 1e-9


def direct_model(rows, deleted):
    """Scores by a plain program: counts in dictionaries, and maximisation over every held-out event by itself."""

    def counts(ids):
        c = [Counter() for _ in range(4)]
        for i in ids:
            t = toks[i]
            for k in range(2, len(t)):
                for n in range(1, 4):
                    c[n][tuple(t[k - n + 1 : k + 1])] += 1
                c[0][()] += 1
        return c

    def level(c, h):  # of a context: 0, or one more than the logarithm of its count
        many = sum(v for g, v in c[len(h) + 1].items() if g[:-1] == h) if h not in seen else seen[h]
        seen[h] = many
        return many, int(math.log2(many)) + 1 if many else 0

    def p(c, g, n, types, w):
        if n == 1:
            return None
        many, k = level(c, g[-n:-1])
        own = c[n][g[-n:]] / many if many else 0.0
        if n == 2:
            return k, (own, c[1][g[-1:]] / c[0][()], 1 / (types + 1)), None
        k2, e2, _ = p(c, g, 2, types, w)
        return k, (own, sum(a * b for a, b in zip(w[2][k2], e2, strict=True))), None

    toks = {i: ["<s>", "<s>", *t.split(), "</s>"] for i, t, _ in rows}
    train = [i for i, _, x in rows if x]
    whole, kept = counts(train), counts([i for i in train if i not in deleted])
    types, w = len(whole[1]), {}
    for n in (2, 3):
        events, seen = defaultdict(list), {}
        for i in train:
            if i in deleted:
                for k in range(2, len(toks[i])):
                    at, e, _ = p(kept, tuple(toks[i][k - 2 : k + 1]), n, types, w)
                    events[at].append(e)
        size, last = (3, (0.4, 0.4, 0.2)) if n == 2 else (2, (0.4, 0.6))
        w[n] = {}
        for at in range(64):
            now = ((0.0, 0.7, 0.3) if n == 2 else (0.0, 1.0)) if at == 0 else last
            if events[at]:
                now = (0.0, *[1 / (size - 1)] * (size - 1)) if at == 0 else (1 / size,) * size
                for _ in range(1000):
                    share = [[a * b / sum(a * b for a, b in zip(now, e, strict=True)) for a, b in zip(now, e, strict=True)] for e in events[at]]
                    new = [max(sum(s), 1e-6 * len(share)) if old else 0.0 for s, old in zip(zip(*share, strict=True), now, strict=True)]
                    new = tuple(x / sum(new) for x in new)
                    done = max(abs(a - b) for a, b in zip(new, now, strict=True)) < 1e-9
                    now = new
                    if done:
                        break
            if at:
                last = now
            w[n][at] = now
    out, seen = {}, {}
    for i, t in toks.items():
        out[i] = 0.0
        for k in range(2, len(t)):
            at, e, _ = p(whole, tuple(t[k - 2 : k + 1]), 3, types, w)
            out[i] += math.log10(sum(a * b for a, b in zip(w[3][at], e, strict=True)))
    return out


def test_scores_against_a_direct_program(spark):
    r = random.Random(8)
    words = [f"w{int(r.expovariate(0.15))}" for _ in range(400)]
    rows = [(i, " ".join(r.choice([r.choice(words), "a b", "a c d"]) for _ in range(r.randint(0, 25))), i % 7 != 2) for i in range(160)]
    df = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    deleted = {x[0] for x in df.where("train and pmod(xxhash64(4, doc_id, text), 8) = 0").select("doc_id").collect()}
    want = direct_model(rows, deleted)
    got = {x["doc_id"]: x["score"] for x in interpolation.score(df, block_bytes=2000).collect()}
    assert len(deleted) > 5 and all(abs(got[i] - want[i]) < 2e-3 * abs(want[i]) + 1e-6 for i in want)


def test_scoring_of_odd_rows(spark):
    df = docs(spark).withColumn("train", F.col("doc_id") < 6)
    assert interpolation.score(df).count() == len(ROWS)
    assert all(r["score"] == 0 for r in interpolation.score(df.withColumn("train", F.lit(None).cast("boolean"))).collect())
    assert interpolation.score(df.limit(0)).count() == 0


# -- 1 and 9: classifiers


def test_toxicity_held_out(spark):
    """Against the labels themselves, on rows that were not learned from."""
    sf = "/root/testdata/sf0.1"
    rows = {r["doc_id"]: r for r in queries()["op1_toxicity"](spark, sf).collect()}
    assert len(rows) == len(table(sf, "documents")) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.5) for r in rows.values())
    held = [(x["toxic"], rows[x["doc_id"]]["predicted"]) for x in table(sf, "labels") if rows[x["doc_id"]]["held_out"]]
    toxic, clean = [p for y, p in held if y], [p for y, p in held if not y]
    assert sum(toxic) / len(toxic) > 0.9 and 1 - sum(clean) / len(clean) > 0.98


def test_toxicity_scores_against_a_direct_program(spark):
    """With a fixed model, scores are those of a plain program over decoded words."""
    words = ["bad", "worsening", "worse", "good", "plain"]
    h = {w: int(toxicity._tokens(pa.array([w]))[0][0][0]) for w in words}
    stem = int(toxicity._tokens(pa.array(["worsex"]))[0][1][0])
    value = {h["bad"]: 2.5, stem: 1.75, h["worse"]: -0.5, h["good"]: -0.25}
    keys = np.array(sorted(value), np.uint64)
    model = toxicity.Model(keys, np.array([value[int(k)] for k in keys]), 0.125, lam=0.8, k=0.02, a=-3.0, b=0.7)
    r = random.Random(1)
    rows = [(i, " ".join(r.choice([*words, "other"]) for _ in range(r.randint(0, 40)))) for i in range(60)] + [(60, None)]

    def token(w):
        return {"bad": 2.5, "worsening": 1.75, "worse": 1.75, "good": -0.375}.get(w, -0.125)

    for x in toxicity.score(spark.createDataFrame(rows, "doc_id long, text string"), model).collect():
        s = [token(w) for w in (x["text"] or "").split()]
        segs = brute_segments(s, 0, len(s))
        odds = sum(math.exp(0.8 * v) / (0.02 * len(s)) for *_, v in segs)
        want = 1 / (1 + math.exp(3.0 - 0.7 * math.log(1 + odds)))
        assert abs(x["score"] - want) < 1e-9
        assert len(x["passages"]) == sum(0.02 * len(s) * math.exp(-0.8 * v) < 0.05 for *_, v in segs)


def test_extreme_value_law():
    """K by maximum likelihood: drawn greatest scores give back the law they were drawn from."""
    r = np.random.Generator(np.random.PCG64(1))
    n, lam, k = r.integers(50, 500, 40_000).astype(float), 0.9, 0.004
    top = np.maximum(0, (np.log(k * n) - np.log(r.exponential(size=40_000))) / lam)
    assert abs(toxicity._censored_k(n, top, lam) / k - 1) < 0.03
    score, p = np.array([-0.5, 1.0]), np.array([0.8, 0.2])
    assert abs((p * np.exp(toxicity._karlin(score, p) * score)).sum() - 1) < 1e-9


def brute_segments(x, lo, hi):
    """Maximal segments by the definition: split at the best segment, again and again."""
    top = None
    for i in range(lo, hi):
        total = 0.0
        for j in range(i, hi):
            total += x[j]
            if total > 1e-12 and (top is None or total > top[2] + 1e-9):
                top = (i, j, total)
    return [] if top is None else brute_segments(x, lo, top[0]) + [top] + brute_segments(x, top[1] + 1, hi)


def test_segments_against_brute_force():
    for seed in range(60):
        r = random.Random(seed)
        x = [r.choice([-0.37, -0.37 - r.random(), -0.37, 0.5 + r.random()]) for _ in range(25)]
        got = toxicity.maximal_segments(np.array(x))
        want = brute_segments(x, 0, len(x))
        assert [(a, b) for a, b, _ in sorted(got)] == [(a, b) for a, b, _ in want]
        assert np.allclose([s for *_, s in sorted(got)], [s for *_, s in want])


def test_toxicity_of_odd_rows(spark):
    labels = spark.createDataFrame([(1, 1), (6, 0), (None, 1), (7, None)], "doc_id long, toxic int")
    df = docs(spark).withColumn("score", F.lit("clash"))
    for own in (labels, labels.limit(0)):
        got = toxicity.score(df, toxicity.train(docs(spark), own)).collect()
        assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 for r in got)
    assert toxicity.score(df.limit(0), toxicity.train(docs(spark, []), labels)).count() == 0


def test_language_held_out(spark):
    sf = "/root/testdata/sf0.01"
    lang = {d["doc_id"]: d["lang"] for d in table(sf, "documents")}
    held = [r for r in queries()["op9_language_id"](spark, sf).collect() if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) / len(held) > 0.97


def test_language_scores_against_a_direct_program(spark):
    """Word first, then the longest n-grams that were seen, by counts in dictionaries."""
    r = random.Random(5)
    roots = {"aa": ["bana", "kolo", "mi"], "bb": ["stern", "kolo", "ü"], "cc": ["zzt", "qu"]}
    word = lambda lang: "".join(r.choice(roots[lang]) for _ in range(r.randint(1, 2)))
    rows = [(i, " ".join(word(lang) for _ in range(r.randint(1, 30))), lang) for i, lang in enumerate(r.choices(list(roots), [5, 4, 1], k=120))]
    rows += [(200, rows[0][1], rows[0][2])]  # a repeated text teaches once
    asked = [(300 + k, " ".join("".join(r.choice("banakolstern") for _ in range(r.randint(1, 6))) for _ in range(5))) for k in range(40)] + [(400, "X"), (401, "?")]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x["doc_id"]: x for x in langid.identify(spark.createDataFrame([*[y[:2] for y in rows], *asked], "doc_id long, text string"), langid.train(df)).collect()}

    def grams(w, n):
        return [(w[k : k + n], k == 0, k + n == len(w)) if n > 1 else w[k] for k in range(len(w) - n + 1)]

    c = {n: {lang: Counter() for lang in roots} for n in (0, 4, 3, 2, 1)}
    for text, lang in {y[1:] for y in rows}:
        for w in text.split():
            c[0][lang][w] += 1
            for n in (4, 3, 2, 1):
                c[n][lang].update(grams(w, n))
    kinds = {n: set().union(*c[n].values()) for n in c}
    logf = lambda n, lang, g: math.log((c[n][lang][g] + 0.1) / (sum(c[n][lang].values()) + 0.1 * (len(kinds[n]) + 1)))
    size = {lang: sum(c[0][lang].values()) + 1 for lang in roots}
    for i, text in [*[y[:2] for y in rows], *asked]:
        found = re.findall("[a-zü]+", text.lower())
        total = {lang: math.log(size[lang] / sum(size.values())) for lang in roots}
        for w in found:
            for n in (0, 4, 3, 2, 1):
                seen = [g for g in ([w] if n == 0 else grams(w, n)) if g in kinds[n]]
                if seen:
                    for lang in roots:
                        total[lang] += sum(logf(n, lang, g) for g in seen) / len(seen)
                    break
        best = max(total.values())
        want = 1 / sum(math.exp(v - best) for v in total.values()) if found else 0.0
        assert abs(got[i]["score"] - want) < 1e-9 and (not found or total[got[i]["lang_pred"]] > best - 1e-9)


def test_a_rare_language_is_learned(spark):
    rows = [(f"plain words number {i}", "en") for i in range(3000)] + [("übrige wörter", "de")]
    model = langid.train(spark.createDataFrame(rows, "text string, lang string"), max_rows=50)
    assert model.langs == ["de", "en"] and len(model.tables[0][0]) < 60


def test_language_of_odd_rows(spark):
    model = langid.train(docs(spark))
    got = {(r["doc_id"], r["text"]): r for r in langid.identify(docs(spark).withColumn("score", F.lit("clash")), model).collect()}
    assert got[2, None]["lang_pred"] == got[3, ""]["lang_pred"] == got[8, "?!"]["lang_pred"] == "und"
    assert got[7, ROWS[6][1]]["lang_pred"] == "de"
    assert langid.identify(docs(spark, []), langid.train(docs(spark, []))).count() == 0
    # an unseen word backs off to its letters
    assert langid.identify(spark.createDataFrame([("Übergröße",)], "text string"), model).first()["lang_pred"] == "de"
