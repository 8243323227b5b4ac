import pytest

from tests.llm.helpers import clashing, prose, rows_of
from tidewater.llm.decontaminate import Template, covered, find_leaks, needed

TRAIN = "A train leaves Paris at 60 km per hour and reaches Lyon after 4 hours, so how far away from Paris is Lyon by rail?"
OTHER = "A train leaves Madrid at 85 miles per hour and reaches Toledo after 7 hours, so how far away from Madrid is Toledo by rail?"
MIXED = "A train leaves Madrid at 85 miles per hour and reaches Toledo after 7 hours, so how far away from Toledo is Madrid by rail?"


@pytest.mark.parametrize("doc, found", [
    (TRAIN, True), (TRAIN.upper(), True), (f"Some text. {OTHER} More.", True), (MIXED, False), ("", False), (None, False),
    (TRAIN.replace("train", "bus"), True), (TRAIN.replace("train", "bus").replace("reaches", "meets").replace("away", "off"), False), ("one two " * 30, False), (TRAIN.split(" at ")[0], False),
])
def test_templates_and_slots(doc, found):
    assert (covered(Template(doc), Template(TRAIN)) >= 0.8) == found


def test_units_are_units_behind_numbers_only():
    a, b = Template("walk 5 km to the old town"), Template("walk 7 miles to the old town")
    assert (a.literal == b.literal).all()
    assert not (Template("walk in the old town now").literal == Template("walk m the old town now").literal).all()


def test_names_are_typed_inside_sentences_only():
    t = Template("Anna met Bob. Carol left")
    assert t.kind.tolist() == [0, 0, 3, 0, 0]


APPLES = "Tom has 5 apples. Tom buys 3 more apples at the shop. Tom then eats 2 of them. How many apples does Tom have left?"


@pytest.mark.parametrize("name, found", [
    ("Anna", True), ("New York", True), ("McDonald", True), ("NASA", True), ("Anna Maria de", False),
])
def test_names_that_begin_sentences(name, found):
    changed = APPLES.replace("Tom", name).replace("5", "9").replace("3", "4")
    assert (covered(Template(f"Some text. {changed} More."), Template(APPLES)) >= 0.8) == found
    assert (covered(Template(APPLES), Template(changed)) >= 0.8) == found


def test_names_that_begin_sentences_map_to_one():
    two = APPLES.replace("Tom buys", "Anna buys").replace("Tom then", "Carl then")
    assert covered(Template(two), Template(APPLES)) < 0.8
    assert covered(Template(APPLES.lower()), Template(APPLES)) == 1 == covered(Template(APPLES.upper()), Template(APPLES))


def test_names_that_begin_sentences_over_tables(spark):
    changed = APPLES.replace("Tom", "New York").replace("5", "9")
    docs = [(i, prose(i, 100)) for i in range(20)] + [(100, f"{prose(7, 40)}. {changed}"), (101, APPLES.replace("apples", "cats")), (102, "Tom Anna. Bob")]
    assert leaks(spark, docs, [(1, APPLES), (2, "Tom Anna Bob Carl Dora Emil")]) == [(100, 1)]


def test_needed():
    assert [needed(n, 0.8) for n in (1, 2, 4, 5, 6, 10)] == [1, 2, 4, 4, 5, 8]


def brute(docs, items):
    first = {}
    for i, t in items:
        if i is not None and t is not None:
            first[t] = min(i, first.get(t, i))
    return sorted({(d, i) for d, t in docs if d is not None for q, i in first.items()
                   if Template(q).size and covered(Template(t), Template(q)) >= 0.8 - 1e-9}, key=repr)


def leaks(spark, docs, items):
    df = find_leaks(clashing(spark, docs, "doc_id bigint, text string"), clashing(spark, items, "item_id bigint, text string"))
    return rows_of(df, "doc_id", "item_id")


def test_against_brute_force(spark):
    items = [(k, prose(100 + k, 12 + k)) for k in range(25)] + [(50, TRAIN), (51, TRAIN), (52, "only four words here"), (53, None), (54, ""),
                                                               (None, "null id item of more than five words"), (55, "3 + 4 = 7, 8 + 9 = 17")]
    docs = [(i, prose(i, 200)) for i in range(60)]
    docs += [(200 + k, f"{prose(k, 50)}\n{items[k % 25][1]}\n{prose(k + 7, 40)}") for k in range(40)]
    partial = " ".join(items[20][1].split()[:16])
    docs += [(300, OTHER), (301, MIXED), (302, partial), (303, None), (304, ""), (None, TRAIN), (305, "only four words here"),
             (306, "and only four words here too"), (307, " ".join(t for _, t in items if t)), (300, OTHER),
             (308, prose(9, 20_000) + " " + TRAIN.lower()), (309, "5 + 6 = 11, 2 + 1 = 3")]
    got = leaks(spark, docs, items)
    assert got == brute(docs, items)
    assert {(200 + k, k % 25) for k in range(40)} <= set(got) and (300, 50) in got and (308, 50) in got and (305, 52) in got and (306, 52) in got
    assert not {d for d, _ in got} & {301, *range(60)}


def test_short_items_are_found_inside_longer_texts(spark):
    items = [(1, "capital of France"), (2, "Paris"), (3, "4 + 4 = 8"), (4, "?!"), (5, "who wrote Hamlet today")]
    docs = [(1, f"{prose(1, 50)} the Capital of France, {prose(2, 50)}"), (2, "capital of Spain"), (3, prose(3, 80)), (4, "It was 4 + 4 = 8."),
            (5, "It was 5 + 5 = 10."), (6, "capital of"), (7, f"In PARIS {prose(4, 30)}"), (8, "who wrote Hamlet today"), (9, "who wrote Othello today")]
    assert leaks(spark, docs, items) == [(1, 1), (4, 3), (7, 2), (8, 5)]


def test_empty_tables(spark):
    assert leaks(spark, [], [(1, TRAIN)]) == [] and leaks(spark, [(1, TRAIN)], []) == []
