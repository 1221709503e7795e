"""Lexicon induction: planted insults, parts against brute force, and odd inputs."""

import math
import random
import re
import tracemalloc
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from keyloom.llm import toxicity as T
from keyloom.llm import wordgraph as W
from keyloom.llm.tokens import U, chunks, hash_words, mix, unmix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
INSULTS = ["idiot", "moron", "scum", "trash", "loser", "clown"]


def corpus(n=600, seed=1, together=False):
    """Every sixth document has three insults, ``together`` or at random places."""
    rng = random.Random(seed)
    plain = ["".join(rng.choices("bcdfglmnprst", k=6)) for _ in range(300)]
    rows, labels = [], []
    for i in range(n):
        words = rng.choices(plain, k=60)
        toxic = i % 6 == 0
        if toxic:
            some = rng.sample(INSULTS, 3)
            for w in [" ".join(some)] if together else some:
                words.insert(rng.randrange(len(words)), w)
        rows.append((i, " ".join(words), "en", "s", 0))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    return rows, labels


def frames(spark, rows, labels):
    return spark.createDataFrame(rows, SCHEMA), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_toxic_documents_are_found_and_clean_ones_left(spark):
    rows, labels = corpus()
    docs, marks = frames(spark, rows, labels)
    found = {r.doc_id for r in T.toxic_documents(docs, marks).collect()}
    assert found == {i for i in range(600) if i % 6 == 0}
    left = T.without_toxic(docs, marks)
    assert {r.doc_id for r in left.collect()} == set(range(600)) - found and left.schema == docs.schema


def test_terms_without_labels_are_induced_by_the_walk(spark):
    rows, labels = corpus(together=True)
    docs, _ = frames(spark, rows, labels)
    # "clown" never occurs in a labelled document
    known = [x for x in labels if "clown" not in rows[x[0]][1]]
    lexicon = T.induce(docs, frames(spark, rows, known)[1])
    assert lexicon.words(INSULTS) == set(INSULTS) and len(lexicon.term) == len(INSULTS)


def test_copies_of_a_toxic_document_don_t_make_its_words_toxic(spark):
    rows, labels = corpus()
    words = rows[0][1]
    rows += [(1000 + i, words + f" x{i}", "en", "s", 0) for i in range(200)]
    labels += [(1000 + i, 1, 1) for i in range(200)]
    lexicon = T.induce(*frames(spark, rows, labels))
    assert len(lexicon.words(INSULTS)) == len(lexicon.term)


def test_counts_are_those_of_all_documents(spark):
    rows, labels = corpus(120)
    rows.append((121, "scum " * 3 + "scum", "en", "s", 0))
    docs, marks = frames(spark, rows, labels)
    sample = T.labelled(docs, marks)
    got = {r.term: (r.n, r.uses, r.toxic, r.clean) for r in T.word_counts(docs, sample).collect()}
    kinds = {}
    for i, _, toxic in labels:
        kinds[i] = toxic
    want = {}
    for i, text, *_ in rows:
        for w, uses in Counter(text.split()).items():
            n = want.setdefault(w, [0, 0, 0, 0])
            n[0] += 1
            n[1] += uses
            if i in kinds:
                n[2 if kinds[i] else 3] += 1
    code = docs.select(T._code(docs)).first()[0]
    terms = mix(hash_words(list(want)) ^ np.array([code]).view(U)).view(np.int64)
    assert got == {t: tuple(n) for t, n in zip(terms.tolist(), want.values())}
    assert (unmix(mix(hash_words(INSULTS))) == hash_words(INSULTS)).all()


def test_walk_is_the_power_of_a_matrix(spark):
    rng = np.random.default_rng(0)
    a, b, w = [0, 0, 1, 3], [1, 2, 2, 4], rng.random(4).tolist()
    m = np.zeros((6, 6))
    for x, y, v in zip(a, b, w):
        m[x, y] = m[y, x] = v
    m = m / np.maximum(m.sum(1, keepdims=True), 1e-300)
    origin = np.array([[0.5, 0, 0, 0.25, 0, 0.25], [0, 1, 0, 0, 0, 0]])
    p = origin
    for _ in range(W.STEPS):
        p = W.DAMPING * p @ m + (1 - W.DAMPING) * origin
    p[:, 5] = origin[:, 5]  # it has no edge
    start = spark.createDataFrame([(i, *origin[:, i].tolist()) for i in range(6) if origin[:, i].any()], "term long, t double, c double")
    got = {r.term: (r.t, r.c) for r in W.walk(spark.createDataFrame(list(zip(a, b, w)), "a long, b long, pmi double"), start, ["t", "c"]).collect()}
    assert all(np.allclose(got.get(i, (0, 0)), p[:, i]) for i in range(6))


def root(k, n, m, total):
    """The signed root of the likelihood ratio, by its definition."""
    g = 0.0
    for c, x, y in ((k, n, m), (n - k, n, total - m), (m - k, total - n, m), (total - n - m + k, total - n, total - m)):
        g += c * math.log(c * total / (x * y)) if c > 0 else 0
    return math.copysign(math.sqrt(max(0, 2 * g)), k * total - n * m) if k * total != n * m else 0.0


def brute_force(rows, labels):
    """{(language, word): (polarity, share)} and {id: score} by dictionaries alone."""
    marks = {}
    for i, _, toxic in labels:
        marks[i] = max(toxic, marks.get(i, 0))
    tokens = {i: re.findall(r"[^\W_]+", text.lower()) for i, text, *_ in rows}
    lang = {i: row_lang for i, _, row_lang, *_ in rows}
    polarity, share = {}, {}
    for me in set(lang.values()):
        mine = [i for i in tokens if lang[i] == me]
        n, uses, toxic, clean = Counter(), Counter(), Counter(), Counter()
        for i in mine:
            uses.update(tokens[i])
            n.update(set(tokens[i]))
            if i in marks:
                (toxic if marks[i] else clean).update(set(tokens[i]))
        stop = {w for w in n if n[w] > max(T.NODE_COUNT, T.NODE_SHARE * len(mine))}
        nodes = {w for w in n if w not in stop and n[w] >= T.NODE_COUNT}
        total = sum(uses[w] for w in uses if w not in stop)
        bads, goods = sum(marks.get(i) == 1 for i in mine), sum(marks.get(i) == 0 for i in mine)
        r = {w: root(toxic[w], bads, toxic[w] + clean[w], bads + goods) if bads + goods else 0.0 for w in nodes}
        bad, good = {w for w in nodes if r[w] >= T.MIN_ROOT}, {w for w in nodes if r[w] <= 0 and clean[w]}
        if not bad:
            continue
        met, kinds = Counter(), defaultdict(set)
        for i in mine:
            some = [w for w in tokens[i] if w not in stop]
            (chunk,) = chunks(pa.array([" ".join(tokens[i])]))
            kind = int(mix(T.sketches(chunk, 1)[:, 0])[0]) >> 60
            for d in range(1, W.WINDOW + 1):
                for x, y in zip(some, some[d:]):
                    if x != y and x in nodes and y in nodes:
                        met[min(x, y), max(x, y)] += 1
                        kinds[min(x, y), max(x, y)].add(kind)
        weight, places = defaultdict(dict), 2 * W.WINDOW
        for (x, y), k in met.items():
            pmi = math.log(k * total / (places * uses[x] * uses[y]))
            if k >= W.EDGE_COUNT and len(kinds[x, y]) >= min(W.EDGE_KINDS, (k + 1) // 2) and pmi > 0 and root(k, places * uses[x], places * uses[y], places * total) >= W.EDGE_ROOT:
                weight[x][y] = weight[y][x] = pmi
        visits = []
        for seeds in (bad, good):
            origin = {w: 1 / len(seeds) for w in seeds}
            p = origin
            for _ in range(W.STEPS):
                q = {w: (1 - W.DAMPING) * v if w in weight else v for w, v in origin.items()}
                for w, v in p.items():
                    for x, pmi in weight[w].items() if w in weight else ():
                        q[x] = q.get(x, 0) + W.DAMPING * v * pmi / sum(weight[w].values())
                p = q
            visits.append(p)
        for w in set(visits[0]) | set(visits[1]):
            t, c = visits[0].get(w, 0), visits[1].get(w, 0)
            polarity[me, w] = (t - c) / (t + c)
            share[me, w] = (toxic[w] + T.PRIOR * max(0, polarity[me, w])) / (toxic[w] + clean[w] + T.PRIOR)
    weights = {w: polarity[w] * share[w] for w in polarity if polarity[w] >= T.MIN_POLARITY and share[w] >= T.MIN_SHARE}
    known = {me for me, _ in weights}
    scores = {}
    for i in tokens:
        total = sum(weights.get((lang[i], w), 0) if lang[i] in known else max((v for (_, x), v in weights.items() if x == w), default=0) for w in tokens[i])
        if total >= T.MIN_SCORE and total / len(tokens[i]) >= T.MIN_RATE:
            scores[i] = total
    return polarity, share, scores


@pytest.mark.parametrize("ranked", [W.RANKED, 40, 0])
def test_the_whole_query_is_what_brute_force_gives(spark, ranked, monkeypatch):
    """Two languages, one of 1 % of the corpus, with words that no label knows; also where few or no nodes have numbers."""
    rng = random.Random(5)
    rows, labels = corpus(700, 3)
    plain = ["".join(rng.choices("aeiouklm", k=5)) for _ in range(40)]
    bads = ["zozo", "zuzu", "zizi"]
    for i in range(7):
        rows.append((10_000 + i, " ".join(rng.choices(plain, k=20) + (bads * 2 if i < 3 else [])), "xx", "s", 0))
        labels.append((10_000 + i, 1, int(i < 3)))
    rows += [(20_000 + i, rows[6 * i][1] + " x", "yy", "s", 0) for i in range(5)]
    rows += [(30_000 + i, rows[i][1] + " goblin " + " ".join(rng.sample(INSULTS, 2)), "en", "s", 0) for i in range(1, 60)]
    docs, marks = frames(spark, rows, labels)
    polarity, share, scores = brute_force(rows, labels)
    monkeypatch.setattr(T, "labelled", unthinned)
    got = {r.term: r for r in T.polarities(docs, marks, ranked=ranked).collect()}
    codes = {r.lang: r.code for r in docs.select("lang", T._code(docs).alias("code")).distinct().collect()}
    term = {w: int(mix(hash_words([w[1]]) ^ np.array([codes[w[0]]]).view(U)).view(np.int64)[0]) for w in polarity}
    assert len(polarity) > 100 and {me for me, _ in polarity} <= {"en", "xx"} and set(got) == set(term.values())
    for w, t in term.items():
        assert math.isclose(got[t].polarity, polarity[w], abs_tol=1e-9) and math.isclose(got[t].share, share[w], abs_tol=1e-9)
    found = {r.doc_id: r.score for r in T.toxic_documents(docs, marks, ranked=ranked).collect()}
    assert found.keys() == scores.keys() and all(math.isclose(found[i], scores[i], rel_tol=1e-9) for i in found)


def unthinned(docs, labels, max_labelled):
    """What :func:`toxicity.labelled` gives where no two texts share a minimum of shingles."""
    joined = T._keyed(docs).join(labels.groupBy("doc_id").agg(F.max("toxic").alias("toxic")), "doc_id").select("key", "code", "toxic")
    return joined.toArrow().cast(pa.schema([("key", pa.int64()), ("code", pa.int64()), ("toxic", pa.int32())])).sort_by("key")


def test_likelihood_ratio_is_signed():
    cases = [(10, 10, 10, 100), (0, 50, 50, 100), (25, 50, 50, 100), (3, 7, 9, 400)]
    got = [float(W.signed_root(*c)) for c in cases]
    assert got[0] > 5 and got[1] < -5 and got[2] == 0 and np.allclose(got, [root(*c) for c in cases])


def test_pairs_survive_packing():
    keys = np.unique(np.random.default_rng(0).integers(0, 1 << 44, 5000).astype(U))
    counts = np.arange(1, len(keys) + 1)
    back = {}
    for batch in W.packed(keys, counts, 7):
        size, k, n = (batch.column(i)[0].as_py() for i in (1, 2, 3))
        a, b = W.unpacked(size, k, n)
        back |= dict(zip(a.tolist(), b.tolist()))
    assert back == dict(zip(keys.tolist(), counts.tolist()))


def test_meetings_are_counted_where_they_lie():
    keys = np.random.default_rng(1).integers(0, 1 << 44, 1 << 19).astype(U)
    keys[1 << 18 :] = keys[: 1 << 18]
    keys[:200_000] = keys[0]
    want = dict(zip(*(x.tolist() for x in np.unique(keys, return_counts=True))))
    size, back, parts = keys.nbytes, {}, []
    tracemalloc.start()
    for batch in W.packed(*W.counted(keys, 7), 7):
        most = tracemalloc.get_traced_memory()[1]
        part, n, k, c = (batch.column(i)[0].as_py() for i in range(4))
        parts.append(part)
        if not back:
            # 12 bytes of eight are counts and parts, the rest is one part of seven
            assert most < 2 * size
        back |= dict(zip(*(x.tolist() for x in W.unpacked(n, k, c))))
    tracemalloc.stop()
    assert back == want and parts == sorted(set(parts))
    for n in (0, 1, 2):
        assert [x.tolist() for x in W.counted(np.full(n, 5, U), 7)] == [[5], [n]] if n else not len(W.counted(np.empty(0, U), 7)[0])


@pytest.mark.parametrize("rows,labels", [([], []), ([(1, "idiot", "en", "s", 0)], []), ([], [(1, 1, 1)])])
def test_empty_tables(spark, rows, labels):
    docs, marks = frames(spark, rows, labels)
    assert T.toxic_documents(docs, marks).count() == 0
    assert T.without_toxic(docs, marks).count() == len(rows)


def test_nulls_long_texts_repeated_rows_and_clashing_columns(spark):
    rows, labels = corpus()
    odd = [(None, rows[0][1], None, None, None), (2000, None, "en", "s", 0), (2001, "", "en", "s", 0), (2002, "!?", None, "s", 0), (2003, "plain " * 200_000, "en", "s", 0), (2004, "idiot moron " + "plain " * 200_000, "en", "s", 0), rows[0], rows[0]]
    labels += [(None, 1, 1), (0, 1, None), (0, 1, 0), (5, None, None)]
    docs, marks = frames(spark, rows + odd, labels)
    docs = docs.withColumn("__code", F.lit("mine")).withColumn("score", F.lit(1)).withColumn("toxic", F.lit("t"))
    scores = T.score(docs, T.induce(docs, marks)).collect()
    assert len(scores) == len(rows + odd)
    by = {}
    for r in scores:
        by.setdefault(r.doc_id, []).append(r)
    assert [r.toxic for r in by[0]] == [1, 1, 1] and by[2000][0].score == 0 and by[2004][0].hits == 2 and by[2004][0].toxic == 0
    left = T.without_toxic(docs.drop("__code"), marks)
    assert left.columns == docs.drop("__code").columns and {2000, 2001, 2002, 2003, 2004} <= {r.doc_id for r in left.collect()}
    assert T.toxic_documents(docs.drop("lang"), marks).count() >= 100


def test_a_small_language_has_nodes_of_its_own(spark):
    rows, labels = corpus(120)
    many = [(10_000 + i, f"zu{i % 7} za{i % 11}", "zz", "s", 0) for i in range(60_000)]
    found = {r.doc_id for r in T.toxic_documents(*frames(spark, rows + many, labels)).collect()}
    assert found == {i for i in range(120) if i % 6 == 0}


def test_documents_without_a_seeded_language_are_scored_by_the_others(spark):
    rows, labels = corpus()
    toxic, clean = rows[0][1], rows[1][1]
    odd = [(3000 + i, text, lang, "s", 0) for i, (text, lang) in enumerate([(toxic, None), (toxic, ""), (toxic, "xx"), (clean, None), (clean, "xx")])]
    docs, marks = frames(spark, rows + odd, labels)
    assert {r.doc_id for r in T.toxic_documents(docs, marks).where("doc_id >= 3000").collect()} == {3000, 3001, 3002}
    assert {r.doc_id for r in T.without_toxic(docs, marks).where("doc_id >= 3000").collect()} == {3003, 3004}


def test_a_term_two_hops_from_the_seeds_is_induced(spark):
    rows, labels = corpus()
    # "clown" meets a seed; "goblin" meets "clown" only; neither is labelled
    base = [(i, text.replace("clown", "x"), *rest) for i, text, *rest in rows]
    base += [(5000 + i, rows[6 * i + 1][1] + " idiot clown", "en", "s", 0) for i in range(40)]
    base += [(6000 + i, rows[6 * i + 2][1] + " clown goblin", "en", "s", 0) for i in range(40)]
    assert T.induce(*frames(spark, base, labels)).words(["clown", "goblin"]) == {"clown", "goblin"}


def test_words_of_one_stem_are_different_terms(spark):
    rows, labels = corpus()
    # toxic documents have "worthless", as many clean ones "worthy"
    rows = [(i, text + (" worthless" if i % 6 == 0 else " worthy" if i % 6 < 3 else ""), *rest) for i, text, *rest in rows]
    assert T.induce(*frames(spark, rows, labels)).words(["worthless", "worthy", "worth"]) == {"worthless"}
