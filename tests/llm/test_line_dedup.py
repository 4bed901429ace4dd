from collections import Counter

from semtflow.llm.line_dedup import dedup_lines


def brute(rows, span=3):
    """Rows that agree in id and text are one document."""
    texts = sorted({((i is not None, i or 0), t or "") for i, t in rows})
    first, gone = {}, {}
    order = {}
    for key, t in texts:
        order.setdefault(key, []).append(t)
    for key, t in texts:
        lines = t.split("\n") if t else []
        gone[key, t] = set()
        for k in range(len(lines) - span + 1):
            run = tuple(lines[k : k + span])
            if first.setdefault(run, (key, t, k)) != (key, t, k):
                gone[key, t].update(range(k, k + span))
    out = Counter()
    for i, t in rows:
        lines, g = (t or "").split("\n") if t else [], gone[(i is not None, i or 0), t or ""]
        out[i, len(lines), len(g), "\n".join(x for k, x in enumerate(lines) if k not in g)] += 1
    return out


def result(df):
    return Counter(map(tuple, dedup_lines(df).collect()))


def test_awkward_documents(spark, awkward, awkward_rows):
    rows = [r[:2] for r in awkward_rows if not (r[0] == 12 and "oak" not in (r[1] or ""))]
    assert result(awkward.filter("row >= 0")).total() == len(awkward_rows)
    clean = spark.createDataFrame(rows, "doc_id long, text string")
    assert result(clean) == brute(rows)


def test_later_occurrences_go(spark):
    rows = [(1, "a\nb\nc\nd"), (2, "x\na\nb\nc\nd\ny"), (3, "a\nb"), (4, "q\nr\ns\nq\nr\ns"), (5, "\n\n\n\n"), (None, "b\nc\nd"), (6, "z\nb\nc\nd")]
    assert result(spark.createDataFrame(rows, "doc_id long, text string")) == brute(rows)


def test_empty(nothing):
    assert dedup_lines(nothing).collect() == []
