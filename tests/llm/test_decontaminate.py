from semtflow.llm.common import table
from semtflow.llm.decontaminate import drop_leaks, leaks

ITEM = "In spring, the farmer Anna sold 12 kg of apples and 7 crates of pears to the shop, and later 12 kg more. How much did she sell in all?"


def found(spark, text, item=ITEM):
    docs = spark.createDataFrame([(1, text)], "doc_id long, text string")
    return [tuple(r) for r in leaks(docs, spark.createDataFrame([(5, item)], "item_id long, text string")).select("_id", "item_id").collect()]


def test_other_values(spark):
    assert found(spark, "Some words before. " + ITEM + " Some words after.")
    assert found(spark, "Lead in. " + ITEM.replace("12", "90").replace("7", "31").replace("Anna", "Bert").replace("kg", "lbs").upper().replace("BERT", "Bert").capitalize())
    assert found(spark, ITEM.replace("12", "90").replace("Anna", "Bert").replace("kg", "miles"))


def test_one_changed_value_of_several(spark):
    """Windows with a substitution that does not hold throughout are lost, the others stand as they are."""
    first = ITEM.index("12")
    assert found(spark, ITEM[:first] + "90" + ITEM[first + 2 :])
    three = "A box holds 12 pens and a shelf holds 12 boxes so how many pens do the 12 men who come by here on a day in May see on it"
    at = three.index("12")
    assert found(spark, three[:at] + "55" + three[at + 2 :], three) and found(spark, three.replace("12", "55"), three)
    assert not found(spark, "A box holds 55 pens and a shelf holds 66 boxes so how many pens do the 77 men who come by here on a day in May see on it", three)


def test_short_items(spark):
    """Items of three or four words match as they are, in any case, and not with other values."""
    for item in ("What is 12 + 7 ?", "Name three rivers."):
        assert found(spark, "before " + item + " after", item) and found(spark, item.upper(), item)
    assert not found(spark, "What is 13 + 7 ?", "What is 12 + 7 ?") and not found(spark, "why not", "Why not?")
    assert not found(spark, "What is it with 12 and 7", "What is 12 + 7 ?")


NAMED = "Last week the baker Rosa gave 12 kg of flour to her friend Hugo while the miller Otto drove 7 km to the town of Lund and met Vera there"


def test_other_case_is_the_same_item(spark):
    for other in (NAMED.lower(), NAMED.upper(), NAMED.title(), NAMED):
        assert found(spark, "some words before. " + other + " some words after.", NAMED), other
    assert found(spark, NAMED, NAMED.lower()) and found(spark, NAMED, NAMED.upper())
    assert found(spark, NAMED.replace("Rosa", "Ida").replace("12", "80"), NAMED)
    assert not found(spark, NAMED.lower().replace("rosa", "ida").replace("hugo", "kim").replace("otto", "leo").replace("lund", "ulm"), NAMED)


def test_other_text_is_left_alone(spark):
    assert not found(spark, "The farmer sold apples. " * 40)
    assert not found(spark, "12 7 12 13 14 15 16", "1 2 3 4 5 6 7 8 9")


def test_given_documents(spark):
    sf = "/root/testdata/sf0.01"
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    items_at = [(r.item_id, r.text) for r in items.collect()]
    want = {(d.doc_id, i) for d in docs.collect() for i, t in items_at if t in d.text}
    assert want and {tuple(r) for r in leaks(docs, items).select("_id", "item_id").collect()} == want
    assert drop_leaks(docs, items).count() == docs.count() - len({d for d, _ in want})


def test_awkward_documents(spark, awkward, awkward_rows, nothing):
    shared = next(r[1] for r in awkward_rows if r[0] == 10)
    items = spark.createDataFrame([(1, shared), (1, shared), (2, None), (3, ""), (4, "too short"), (6, "no such item here"), (None, shared)], "item_id long, text string")
    kept = drop_leaks(awkward, items)
    assert kept.columns == awkward.columns
    assert sorted(r.row for r in kept.collect()) == sorted(r[6] for r in awkward_rows if shared not in (r[1] or ""))
    assert drop_leaks(awkward, items.limit(0)).count() == len(awkward_rows) and drop_leaks(nothing, items).count() == 0
