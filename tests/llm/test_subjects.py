import random

import numpy as np

from sievemark.llm import subjects
from sievemark.llm.subjects import DIMENSIONS, Model, Tree, bisecting_kmeans, leaf_mixtures, subject_shares, subjects_of, terms_of

WORDS = {"chem": ["溶液", "氧化", "酸碱", "沉淀", "试管", "滴定"], "law": ["合同", "法院", "原告", "判决", "仲裁", "证据"], "sport": ["球队", "射门", "冠军", "教练", "比分", "决赛"]}
NEUTRAL = ["请大家把这一页读两遍。", "答题时请写完整的句子。", "以上内容只要求了解。"]


def text_of(rng, parts):
    out = []
    for s in parts:
        out.append(rng.choice(NEUTRAL) if s is None else f"材料{rng.randint(1, 99)}说{rng.choice(WORDS[s])}和{rng.choice(WORDS[s])}与{rng.choice(WORDS[s])}有关。")
    rng.shuffle(out)
    return "".join(out)


def corpus(n=400):
    rng, rows, truth = random.Random(7), [], {}
    for i in range(n):
        a, b = rng.sample(list(WORDS), 2)
        k = rng.choice([0, 0, 1, 4])
        parts = [a] * 5 + [b] * k + [None] * 2
        rows.append((i, text_of(rng, parts)))
        truth[i] = {a} | ({b} if k >= 0.25 * len(parts) else set())
    return rows, truth


def test_finds_subjects(spark):
    rows, truth = corpus()
    extra = [(1001, None), (1002, " "), (1003, "。。。123"), (None, rows[0][1]), (1004, NEUTRAL[0]), (1005, "法院和判决与原告和合同与证据和仲裁有关。" * 20_000)]
    docs = spark.createDataFrame([(k, t, 1, "x") for k, t in rows + extra], "doc_id long, text string, share int, subject_code string")
    rng = random.Random(8)
    labels = [(i, s if rng.random() > 0.08 else "sport", "r") for i in range(120) for s in truth[i]] * 2 + [(5, "nonsense", "r"), (None, "law", "r"), (6, None, "r")]
    lab = spark.createDataFrame(labels, "doc_id long, subject_code string, text string")
    sub = spark.createDataFrame([(s, 1) for s in [*WORDS, None, "never"]], "subject_code string, text int")
    got = {}
    for r in subjects_of(subject_shares(docs, lab, sub)).collect():
        got.setdefault(r.doc_id, set()).add(r.subject_code)
    tp = sum(len(got.get(i, set()) & s) for i, s in truth.items())
    assert tp >= 0.95 * sum(map(len, truth.values())) and tp >= 0.95 * sum(len(got.get(i, ())) for i in truth)
    assert not {1001, 1002, 1003, 1004, None} & set(got) and got[1005] == {"law"}
    assert subject_shares(docs.limit(0), lab, sub).count() == 0
    assert subject_shares(docs, lab.limit(0), sub).count() == 0
    assert subject_shares(docs, lab, sub.limit(0)).count() == 0


def test_sentences_and_terms():
    t = terms_of(["1. 甲乙丙。\nNo end here 3.5 yes. Next one", "", "12。", "丁"])
    assert t.owner.tolist() == [0, 0, 0, 3]
    assert np.bincount(t.sentence, minlength=4).tolist() == [2, 4, 2, 0]
    a, b = terms_of(["Ｗord ABC"]), terms_of(["word abc"])
    assert a.bucket.tolist() == b.bucket.tolist()
    assert terms_of(["a" * 100_000]).bucket.shape == (1,)


def test_bisecting(spark):
    rng = np.random.default_rng(0)
    x = np.concatenate([rng.normal(c, 0.05, (40, DIMENSIONS)) for c in 2 * np.eye(DIMENSIONS)[:3]])
    rows = [(i, np.rint(127 * v / np.linalg.norm(v)).astype(np.int8).tobytes()) for i, v in enumerate(x)]
    vectors = spark.createDataFrame(rows, "h long, vec binary").repartition(3)
    tree = bisecting_kmeans(vectors, 3, 5)
    leaf = tree.leaves(tree.centred(np.stack([np.frombuffer(v, dtype=np.int8) for _, v in rows])))
    assert sorted(np.bincount(leaf)) == [40, 40, 40] and all(len(set(leaf[k : k + 40])) == 1 for k in (0, 40, 80))
    assert not bisecting_kmeans(vectors.where("h < 3"), 4, 5).splits and not bisecting_kmeans(vectors.limit(0), 4, 5).splits


def test_every_vector_moves_the_start(spark):
    """Vectors that come late by their hash shape the leaves like all others."""
    rng, e = np.random.default_rng(1), 2 * np.eye(DIMENSIONS)
    common = np.concatenate([rng.normal(c, 0.01, (2_100, DIMENSIONS)) for c in (e[0], -e[0])])
    late = np.concatenate([rng.normal(e[c] + e[0] / 4, 0.01, (n, DIMENSIONS)) for c, n in ((1, 40), (2, 60), (3, 90))])
    rows = [(i, np.rint(127 * v / np.linalg.norm(v)).astype(np.int8).tobytes()) for i, v in enumerate(np.concatenate([common, late]))]
    tree = bisecting_kmeans(spark.createDataFrame(rows, "h long, vec binary").repartition(3), 6, 20)
    leaf = tree.leaves(tree.centred(np.stack([np.frombuffer(v, dtype=np.int8) for _, v in rows])))
    assert sorted(np.bincount(leaf))[:3] == [40, 60, 90] and all(len(set(leaf[k : k + n].tolist())) == 1 for k, n in ((4_200, 40), (4_240, 60), (4_300, 90)))


def test_passes_start_few_tasks(spark):
    """Starting tasks costs more than summing a few vectors: few vectors are no more than a task a pass, however they are stored."""
    rng = np.random.default_rng(2)
    x = np.concatenate([rng.normal(c, 0.05, (40, DIMENSIONS)) for c in 2 * np.eye(DIMENSIONS)[:3]])
    rows = [(np.rint(127 * v / np.linalg.norm(v)).astype(np.int8).tobytes(),) for v in x]
    vectors = subjects.durable(spark.createDataFrame(rows, "vec binary").repartition(8), "test")
    context = spark.sparkContext
    context.setJobGroup("passes", "")
    try:
        assert len(bisecting_kmeans(vectors, 3, 5).splits) == 2
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
    status = context.statusTracker()
    stages = [s for j in status.getJobIdsForGroup("passes") if (info := status.getJobInfo(j)) for s in info.stageIds]
    tasks = [info.numCompletedTasks for s in stages if (info := status.getStageInfo(s))]
    assert len(tasks) >= 10 and sum(t > 1 for t in tasks) <= 1  # the first pass counts the vectors


def test_sums_of_passes(spark, monkeypatch):
    """The same sums, whether the driver or the executors add up those of tasks."""
    rng = np.random.default_rng(3)
    x = rng.integers(-40, 41, (600, DIMENSIONS)).astype(np.int8)
    vectors = spark.createDataFrame([(v.tobytes(),) for v in x], "vec binary").repartition(3)
    tree = Tree(rng.normal(0, 0.01, DIMENSIONS), [(0, *rng.normal(size=(2, DIMENSIONS))), (1, *rng.normal(size=(2, DIMENSIONS)))])
    tries = [{leaf: tuple(rng.normal(size=(2, DIMENSIONS))) for leaf in some} for some in ((0, 2), (2,))]
    y = tree.centred(x).astype(float)
    leaf = tree.leaves(y)
    for tasks, direct in ((0, 0), (3, 0), (3, 1 << 30)):
        monkeypatch.setattr(subjects, "_DIRECT", direct)
        got = subjects._sums(vectors, tree, tries, moments=True, tasks=tasks)
        for j, centres in enumerate(tries):
            for k, (a, b) in centres.items():
                for side in (0, 1):
                    z = y[(leaf == k) & ((y @ (b - a) > 0) == side)]
                    n, total, outer = got.pop((j, k, side))
                    assert n == len(z) > 0 and np.allclose(total, z.sum(0), atol=1e-3) and np.allclose(outer, z.T @ z, atol=1e-3)
        assert not got


def test_odds_of_sentences_are_summed_whole():
    rng = np.random.default_rng(4)
    table, length = np.asfortranarray(rng.normal(size=(50, 7)).astype(np.float32)), [1, 70, 32, 33, 1, 1500, 64, 2]
    row, first = rng.integers(0, 50, sum(length)), np.cumsum([0, *length[:-1]])
    got = subjects._sums_of_rows(table, row, first)
    assert np.allclose(got, [table[row[a : a + n]].sum(0) for a, n in zip(first, length, strict=True)], atol=1e-3)
    texts = ["甲乙丙丁。" + "甲乙" * 500 + "。丙丁甲。", "Some words. More words here! 甲乙"]
    t = terms_of(texts)
    bucket = np.unique(t.bucket)[::2]
    odds = np.asfortranarray(rng.normal(1, 2, (len(bucket), 6)).astype(np.float32))
    model = Model(bucket, odds, np.array([0, 1, 0]), np.array([3, 4, 3]))
    assert model.both.flags.c_contiguous  # else each row would be gathered from all over the table
    for k, leaf in enumerate(model.sentence_leaves(t)):
        mine = t.bucket[t.sentence == k]
        sums = odds[[i for b in mine for i in np.flatnonzero(bucket == b)]].sum(0)
        both = sums[:3] + sums[[3, 4, 3]]
        top = sums[[3, 4, 3][both.argmax()]]
        assert leaf == (both.argmax() if top > max(subjects.SENTENCE_ODDS, subjects.TERM_ODDS * len(mine)) else -1)


def test_long_labelled_documents_take_part(spark):
    """A label counts whatever the length of its document."""
    rows, truth = corpus(200)
    long_ = [(2000 + k, "".join(text_of(random.Random(k), [s] * 12) for _ in range(150))) for k, s in enumerate(WORDS)]
    assert min(len(t) for _, t in long_) > 20_000
    docs = spark.createDataFrame(rows + long_, "doc_id long, text string")
    lab = spark.createDataFrame([(2000 + k, s) for k, s in enumerate(WORDS)], "doc_id long, subject_code string")
    sub = spark.createDataFrame([(s,) for s in WORDS], "subject_code string")
    got = {(r.doc_id, r.subject_code) for r in subjects_of(subject_shares(docs, lab, sub)).collect()}
    want = {(i, s) for i, t in truth.items() for s in t}
    assert len(got & want) >= 0.9 * len(want)


def test_mixtures_add_up(spark):
    rows, truth = corpus(150)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    lab = spark.createDataFrame([(i, s) for i in range(80) for s in truth[i]], "doc_id long, subject_code string")
    sub = spark.createDataFrame([(s,) for s in WORDS], "subject_code string")
    leaf = leaf_mixtures(docs, lab, sub, leaves=6).collect()
    total = {}
    for r in leaf:
        total[r.doc_id] = total.get(r.doc_id, 0) + r.share
        assert abs(r.share * r.n_sentences - round(r.share * r.n_sentences)) < 1e-9
    assert len({r.leaf for r in leaf}) > 2 and max(total.values()) <= 1 + 1e-9
