import random
import re

import pyarrow as pa
from paneflow.llm import decontaminate
from pyspark.sql import functions as F

ITEM = "A farmer named Albert sells 12 apples for 3 dollars at the old market while his neighbour Berta buys 7 pears"
OTHER = "A farmer named Conrad sells 45 apples for 9 dollars at the old market while his neighbour Dora buys 8 pears"
BROKEN = "A farmer named Albert walked 12 times for 3 dollars through a wood while some neighbour slept and no pears were bought"


def tables(spark, texts, items=((7, ITEM),)):
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, item_id string, slots int")
    return docs, spark.createDataFrame(list(items), "item_id long, text string")


def test_copies_and_reparameterised_questions(spark):
    texts = ["filler words " * 30 + ITEM + " more filler" * 30, "before this line " + OTHER + " and after", BROKEN, None, "", "clean text about nothing at all", ITEM.upper(), "pad " * 50_000 + ITEM]
    docs, items = tables(spark, texts)
    found = {r.doc_id: r for r in decontaminate.find(docs, items).collect()}
    assert sorted(found) == [0, 1, 6, 7]
    assert found[0].plain_share == 1.0 and found[1].template_share >= 0.9 and found[1].changed_slots >= 4
    kept = decontaminate.clean(docs, items)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == [2, 3, 4, 5]


def test_inconsistent_slots_are_no_match(spark):
    item = "If 5 boxes hold 20 pens then how many pens do 5 boxes and then 5 boxes again hold together"
    same = item.replace("5", "8").replace("20", "32")
    mixed = "If 4 boxes hold 20 pens then how many pens do 6 boxes and then 9 boxes again hold together"
    docs, items = tables(spark, [same, mixed], [(1, item)])
    template = {r.doc_id: r.template_share for r in decontaminate.find(docs, items).collect()}
    assert template.get(0, 0) > 0.8 and not template.get(1, 0)


def test_empty_tables_and_a_full_sieve(spark, monkeypatch):
    docs, items = tables(spark, [ITEM, "x"], [(1, ITEM), (1, ITEM), (2, None), (3, "too short"), (None, OTHER)])
    assert decontaminate.find(docs.limit(0), items).collect() == []
    assert decontaminate.find(docs, items.limit(0)).collect() == []
    whole = sorted(map(tuple, decontaminate.find(docs, items).collect()), key=str)
    monkeypatch.setattr(decontaminate, "SIEVE_BITS", 14)
    assert sorted(map(tuple, decontaminate.find(docs, items).collect()), key=str) == whole


def test_documents(spark, sf_dir):
    docs, items = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "benchmark"))
    plain = lambda t: " ".join(re.findall(r"[^\W\d_]+|\d+", (t or "").lower()))
    want = {(d.doc_id, b.item_id) for d in docs.collect() for b in items.collect() if plain(b.text) in plain(d.text)}
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, items).collect()}
    assert want and want <= got and len(got - want) <= len(want)


NAMED = "Natalia sold 48 clips in April. Betty sold 12 clips in May. Natalia paid 5 dollars. How many clips were left?"


def test_sentences_that_open_with_names(spark):
    other = "Martin sold 77 clips in June. Clara sold 31 clips in July. Martin paid 9 dollars. How many clips were left?"
    unlike = "Martin sold 77 clips in June. Then nobody wanted any more. Clara walked home and slept. How many nights were left?"
    docs, items = tables(spark, [other, f'He read: "{other}" and left', "pad " * 20 + "\n" + other, unlike], [(1, NAMED)])
    found = {r.doc_id: r for r in decontaminate.find(docs, items).collect()}
    assert sorted(found) == [0, 1, 2] and all(r.template_share == 1.0 for r in found.values())


def test_slot_values_of_other_lengths(spark):
    item = "At the village fair Albert sold 12 jars of plum jam to the baker, who later asked whether Berta could bring 5 more baskets of ripe cherries before the market closed for the winter"
    slots = item.replace("12", "twenty five").replace("Albert", "Mary Ann").replace("5", "3/4")
    words = item.replace("plum jam", "very sweet plum jam").replace("bring 5", "perhaps still bring 9")
    mixed = "At the village fair " + item[-60:] + " and so on " + item[20:50]
    docs, items = tables(spark, ["so " + slots + " again", "so " + words.replace("12", "30"), mixed], [(1, item)])
    found = {r.doc_id: r for r in decontaminate.find(docs, items).collect()}
    assert sorted(found) == [0, 1]
    assert found[0].template_share == 1.0 and found[0].changed_slots >= 3 and found[1].template_share >= 0.5


def test_verbatim_runs_and_short_items(spark):
    words = [f"w{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    run, less = " ".join(words[100:113]), " ".join(words[100:112])
    docs, items = tables(spark, [f"x {run} y", f"x {less} y", "say Too short now", "too long short", "alone", None], [(1, " ".join(words)), (2, "too short"), (3, "alone"), (4, " . "), (5, "too short")])
    found = {(r.doc_id, r.item_id): r.plain_share for r in decontaminate.find(docs, items).collect()}
    assert sorted(found) == [(0, 1), (2, 2), (2, 5), (4, 3)] and 0 < found[0, 1] < 0.5 and found[2, 2] == 1.0
    assert sorted(r.doc_id for r in decontaminate.clean(docs, items).collect()) == [1, 3, 5]


def test_the_join_loses_no_pair(spark):
    """Each text compared in full with every item, against the join of rare windows."""
    docs, items = (spark.read.parquet(f"/root/testdata/sf0.01/{t}.parquet") for t in ("documents", "benchmark"))
    rows, held = docs.select("doc_id", "text").collect(), items.collect()
    texts = pa.array([r.text or "" for r in rows], pa.large_string())
    every = decontaminate.Index([r.item_id for r in held], [r.text for r in held])
    want = {(rows[r].doc_id, every.items[i]): tuple(x) for r, i, *x in every.find(texts)}
    got = {(r.doc_id, r.item_id): tuple(r)[2:] for r in decontaminate.find(docs, items).collect()}
    assert want and got == want


WORDS = "river garden window candle pocket winter market bridge forest letter island mirror basket silver button ladder wagon pillow carpet kettle lantern meadow orchard saddle barrel anchor feather harbour village shadow".split()
NAMES = "Albert Berta Conrad Dora Emil Frieda Gustav Helene Ingo Johanna Karl Lotte".split()


def test_recall_of_reparameterised_items(spark):
    """Items made of a template with names and numbers; each document holds one with other values, or the words of one in another order."""
    rng = random.Random(3)

    def item():
        parts, slots = [], 0
        for _ in range(rng.randrange(4, 9)):
            parts += rng.sample(WORDS, rng.randrange(3, 6)) + [f"<{'name' if rng.random() < 0.5 else 'number'}{rng.randrange(3)}>"]
        return "once " + " ".join(parts) + " then how many are left"

    def fill(template):
        values = {f"<name{i}>": n for i, n in enumerate(rng.sample(NAMES, 3))} | {f"<number{i}>": str(n) for i, n in enumerate(rng.sample(range(2, 900), 3))}
        for slot, value in values.items():
            template = template.replace(slot, value)
        return template

    templates = [item() for _ in range(120)]
    items = [(i, fill(t)) for i, t in enumerate(templates)]
    noise = lambda: " ".join(rng.choices(WORDS, k=60))
    texts = [f"{noise()} {fill(t)} {noise()}" for t in templates]
    mixed = [" ".join(rng.sample(fill(t).split(), len(t.split()))) for t in templates]
    docs, held = tables(spark, texts + mixed, items)
    got = {(r.doc_id, r.item_id) for r in decontaminate.find(docs, held).collect()}
    assert len({(i, i) for i in range(120)} & got) >= 0.9 * 120
    assert all(d < 120 and d == i for d, i in got)


def test_internal_names_as_extra_columns(spark):
    names = ["mark", "row", "item", "number", "items", "doc_id2", "mark2", "key", "a.b"]
    docs = spark.createDataFrame([(1, ITEM), (2, "clean"), (2, "clean"), (None, None)], "doc_id long, text string").select("doc_id", "text", *(F.lit(n).alias(n) for n in names))
    held = spark.createDataFrame([(1, OTHER)], "item_id long, text string")
    kept = decontaminate.clean(docs, held)
    assert kept.columns == docs.columns and sorted(map(tuple, kept.collect()), key=str) == sorted([(2, "clean", *names)] * 2 + [(None, None, *names)], key=str)


TONGUES = {
    "en": ("Yesterday the baker sold twelve loaves and five pounds of butter to Natalia before he closed, and later asked whether she could bring seven more baskets", {"twelve": "31", "five": "ninety", "pounds": "kilograms", "Natalia": "Émile", "seven": "two"}),
    "de": ("gestern verkaufte ihm die bäckerin zwölf brote und fünfundzwanzig Gramm butter, worauf Natalia später fragte ob sie noch sieben körbe kirschen bringen könne", {"zwölf": "31", "fünfundzwanzig": "drei", "Gramm": "Pfund", "Natalia": "Özlem", "sieben": "achtzig"}),
    "fr": ("hier le boulanger vendait douze pains et cinq kilos de beurre avant la fermeture, puis demandait si, selon Natalia, on pouvait apporter sept paniers de cerises", {"douze": "31", "cinq": "quatorze", "kilos": "grammes", "Natalia": "Émile", "sept": "vingt"}),
    "es": ("ayer el panadero vendió doce panes y cinco kilos de mantequilla antes del cierre, y luego preguntó si, según Natalia, se podían traer siete cestas de cerezas", {"doce": "31", "cinco": "veintidós", "kilos": "gramos", "Natalia": "Ángel", "siete": "treinta"}),
}


def test_reparameterised_items_of_four_languages(spark):
    texts, items = [], []
    for i, (item, values) in enumerate(TONGUES.values()):
        items.append((i, item))
        for old, new in values.items():
            item = item.replace(old, new)
        texts.append(f"so {item} and so on")
    docs, held = tables(spark, texts, items)
    found = {(r.doc_id, r.item_id): r for r in decontaminate.find(docs, held).collect()}
    assert sorted(found) == [(i, i) for i in range(4)]
    assert all(r.template_share == 1.0 and r.changed_slots == 5 for r in found.values())
    # without the words of the other three languages their numbers and units stay literals
    less = {(r.doc_id, r.item_id): r.template_share for r in decontaminate.find(docs, held, words={"en": decontaminate.WORDS["en"]}).collect()}
    assert less[0, 0] == 1.0 and all(less.get((i, i), 0) < 1.0 for i in (1, 2, 3))


def test_letters_and_capitals_of_unicode():
    texts = pa.array(["«École» — ¿Ñandú? “ÜBER l’été” 3,5", "école ñandú über l été 3,5", "x Émile y, Ωmega Ж \U0001d400b", "ab\u0301c", "5 m", "m 5", ""], pa.large_string())
    h, kind, bounds = decontaminate.canonical(texts)
    assert bounds.tolist() == [0, 6, 12, 18, 19, 21, 23, 23]
    assert (h[:6] == h[6:12]).all()
    assert kind[:6].tolist() == [4, 4, 4, 0, 0, 1] and kind[12:18].tolist() == [0, 3, 0, 3, 3, 0]
    # a letter is a unit after a number only
    assert kind[19:].tolist() == [1, 2, 0, 1]


def test_rows_meet_their_own_items_alone():
    """Items given by row report what each text compared with its items by itself reports."""
    texts = [ITEM + " and " + OTHER, OTHER, BROKEN, "alone", ITEM]
    asked = [(0, ITEM), (0, NAMED), (0, "alone"), (1, OTHER), (2, ITEM), (3, "alone"), (3, ITEM), (4, NAMED), (4, OTHER)]
    index = decontaminate.Index([f"{r}:{k}" for k, (r, _) in enumerate(asked)], [t for _, t in asked], decontaminate.np.array([r for r, _ in asked]))
    got = [(r, index.items[i], *x) for r, i, *x in index.find(pa.array(texts, pa.large_string()))]
    want = []
    for r, text in enumerate(texts):
        own = [k for k, (row, _) in enumerate(asked) if row == r]
        alone = decontaminate.Index([f"{r}:{k}" for k in own], [asked[k][1] for k in own])
        want += [(r, alone.items[i], *x) for _, i, *x in alone.find(pa.array([text], pa.large_string()))]
    assert got == want and {r for r, *_ in got} == {0, 1, 3, 4}


def test_long_lists_come_in_parts(spark, monkeypatch):
    items = [(i, ITEM if i % 2 else OTHER) for i in range(40)]
    docs, held = tables(spark, [ITEM, ITEM, "clean", None], items)
    whole = sorted(map(tuple, decontaminate.find(docs, held).collect()))
    assert len(whole) == 80
    monkeypatch.setattr(decontaminate, "ASKED_BYTES", 300)
    assert sorted(map(tuple, decontaminate.find(docs, held).collect())) == whole
