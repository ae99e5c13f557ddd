import pytest

from tidemark.llm import templates

ITEM = "A train leaves at 5 km per hour and Alice walks 5 km while Bob waits 7 hours for the train"
PLAIN = "plain words that ask something about the weather in a town near the sea today"


@pytest.fixture(scope="module")
def benchmark(spark):
    return spark.createDataFrame([(1, ITEM), (2, None), (3, "too short"), (4, PLAIN), (4, PLAIN)], "item_id long, text string")


def held(spark, text, benchmark):
    return templates.contaminated(spark.createDataFrame([(9, text)], "doc_id long, text string"), benchmark).first()["items"]


def test_other_values_in_the_same_slots_are_caught(spark, benchmark):
    assert held(spark, f"x y {ITEM} z", benchmark) == [1]
    assert held(spark, "So a train leaves at 9 km per hour and Carol walks 9 km while Dave waits 3 hours for the train", benchmark) == [1]
    assert held(spark, PLAIN.upper(), benchmark) == [4] and held(spark, PLAIN.replace(" ", "\n  "), benchmark) == [4]


def test_slots_must_agree(spark, benchmark):
    assert held(spark, "A train leaves at 9 km per hour and Carol walks 8 km while Dave waits 3 hours for the train", benchmark) == []


def test_parts_and_other_text_are_left_alone(spark, benchmark):
    assert held(spark, " ".join(PLAIN.split()[:8]), benchmark) == [] and held(spark, "too short", benchmark) == []


def test_planted_items_as_brute_force(spark, sf, texts):
    import pyarrow.parquet as pq

    items = pq.read_table(f"{sf}/benchmark.parquet").to_pydict()["text"]
    squeeze = lambda t: " ".join(t.lower().split())
    want = {i for i, t in texts.items() if any(squeeze(x) in squeeze(t) for x in items)}
    got = templates.contaminated(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/benchmark.parquet"))
    assert {r["doc_id"] for r in got.where("contaminated").collect()} == want and got.count() == len(texts)


def test_odd_rows(spark, odd, none, benchmark):
    assert templates.contaminated(odd, benchmark).where("contaminated").count() == 0
    assert templates.contaminated(odd, benchmark).count() == odd.count()
    kept = templates.without_contaminated(odd, benchmark)
    assert kept.columns == odd.columns and kept.count() == odd.count()
    assert templates.contaminated(none, benchmark).count() == 0 and templates.contaminated(odd, benchmark.limit(0)).count() == odd.count()
    whole = templates.without_contaminated(odd.unionByName(odd.limit(1).withColumn("text", templates.F.lit(PLAIN))), benchmark)
    assert whole.count() == odd.count()


def test_ids_of_any_type_and_one_other_value(spark):
    item = "Alice has 12 red apples and Bob has 7 green pears so how many fruits do Alice and Bob hold together when 3 apples and 7 pears rot in the shed near the old mill where nobody looks after them during the long wet autumn days"
    b = spark.createDataFrame([("q/1", item)], "item_id string, text string")
    assert held(spark, f"Then {item} and so on", b) == ["q/1"] and held(spark, "nothing of it", b) == []
    assert held(spark, item.replace("7 pears", "8 pears"), b) == ["q/1"]  # one slot that disagrees does not hide the rest


def test_items_of_numbers_and_short_ones_inside_a_sentence(spark):
    b = spark.createDataFrame([(1, "1 2 3 5 8 13 21 34 55"), (2, "Paris lies on which long river")], "item_id long, text string")
    assert held(spark, "go on with 1 2 3 5 8 13 21 34 55 please", b) == [1] and held(spark, "go on with 2 3 5 8 13 21 34 55 89 please", b) == []
    assert held(spark, "they ask whether Paris lies on which long river today", b) == [2]


def test_asked_again_with_other_values_on_a_table(spark):
    """Every item with other numbers and names, planted in half of the texts, against what was planted; the items share their beginning."""
    import random

    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefghijklmno") for _ in range(rng.randint(3, 8)))
    frames = [[word() for _ in range(14)] for _ in range(40)]

    def asked(frame):
        n, m, who = rng.randint(2, 499), rng.randint(500, 999), word().capitalize()
        return " ".join(["which of the following is true", *frame[:5], str(n), *frame[5:9], "while", who, "says", str(n), "and", str(m), *frame[9:], "as", who, "says"])

    items = [(i, asked(f)) for i, f in enumerate(frames)]
    docs, want = [], {}
    for k in range(240):
        body = [word() for _ in range(60)]
        if k % 2 == 0:
            body[30:30] = asked(frames[k // 2 % 40]).split()
            want[k] = [k // 2 % 40]
        docs.append((k, " ".join(body)))
    out = templates.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string"))
    assert {r["doc_id"]: r["items"] for r in out.where("contaminated").collect()} == want
