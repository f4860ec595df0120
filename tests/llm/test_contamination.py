from __future__ import annotations

import re

from pyspark.sql import functions as F

from revdiff.llm import decontaminate

from .conftest import EDGE, SCHEMA, prose, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def words(text):
    return WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(texts, items, window=13):
    out = []
    for t in texts:
        w, hit, names = words(t), set(), set()
        for name, item in items:
            iw = words(item)
            n = min(window, len(iw))
            for s in range(len(iw) - n + 1 if n else 0):
                for p in range(len(w) - n + 1):
                    if w[p : p + n] == iw[s : s + n]:
                        hit.update(range(p, p + n))
                        names.add(str(name))
        out.append((len(w), len(hit), tuple(sorted(names))))
    return out


def inputs(spark):
    items = [(i, prose(500 + i, 40)) for i in range(12)] + [(20, "short item"), (21, prose(500, 40)), (22, None), (23, ""), (24, "one"), (None, prose(501, 40)), (20, "short item")]
    part = lambda i, a, b: " ".join(prose(500 + i, 40).split(" ")[a:b])
    texts = [prose(i, 60) + " " + part(i, 3, 20) + "! " + prose(40 + i, 30) for i in range(10)] + [part(2, 0, 12), part(3, 0, 13).upper(), part(4, 5, 18) + " " + part(5, 0, 30), "a short, ITEM.", "one", prose(77, 2000) + " " + part(6, 0, 14)]
    return texts + EDGE, items, spark.createDataFrame(items, "item_id bigint, text string")


def rows(found):
    return sorted((r.doc_id, r.n_words, r.n_hit, tuple(sorted(r["items"])), tuple((s.start, s.end) for s in r.spans)) for r in found.collect())


def test_equals_brute_force_in_one_block_and_in_many(spark):
    texts, items, bench = inputs(spark)
    docs = table(spark, texts)
    got = rows(decontaminate.find_contamination(docs, bench))
    assert [g[1:4] for g in got] == brute(texts, [x for x in items if x[0] is not None])
    assert all(sum(e - s for s, e in g[4]) == g[2] for g in got)
    assert rows(decontaminate.find_contamination(docs, bench, block_rows=60)) == got


def test_dropping(spark):
    texts, items, bench = inputs(spark)
    docs = table(spark, texts)
    want = {i for i, (n, h, _) in enumerate(brute(texts, [x for x in items if x[0] is not None])) if not (h > 0 and 20 * h >= n)}
    for block in (200_000, 60):
        kept = decontaminate.drop_contaminated(docs, bench, block_rows=block)
        assert set(kept.columns) == set(docs.columns) and {r.doc_id for r in kept.collect()} == want
    assert decontaminate.drop_contaminated(docs, bench.limit(0)).count() == len(texts)


def test_dropping_judges_each_row_in_any_number_of_blocks(spark):
    bench = spark.createDataFrame([(1, prose(500, 14)), (2, prose(501, 13))], "item_id bigint, text string")
    bad, other = prose(1, 40) + " " + prose(500, 14), prose(501, 13)
    texts = [bad, prose(2, 50), prose(3, 50), bad, bad, other, None, None, "", prose(2, 50)]
    ids = [None, None, 5, 5, 6, 6, 7, None, 5, 8]
    docs = table(spark, texts, ids=ids)
    docs = docs.select("text", *[c for c in docs.columns if c != "text"])
    want = sorted((str(i), str(t)) for i, t in zip(ids, texts) if t not in (bad, other))
    for block in (200_000, 1):
        kept = decontaminate.drop_contaminated(docs, bench, block_rows=block)
        assert kept.columns == docs.columns
        assert sorted((str(r.doc_id), str(r.text)) for r in kept.collect()) == want


def test_edge_cases(spark, edge):
    bench = spark.createDataFrame([(1, "two words"), (2, None)], "item_id bigint, text string")
    got = decontaminate.find_contamination(edge, bench)
    assert got.count() == len(EDGE) and got.filter("n_hit > 0").count() == 3
    assert decontaminate.find_contamination(spark.createDataFrame([], SCHEMA), bench).count() == 0
    none = decontaminate.find_contamination(edge, bench.filter(F.col("text").isNull()))
    assert none.filter("n_hit > 0").count() == 0 and none.count() == len(EDGE)
