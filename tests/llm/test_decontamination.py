import random
from collections import Counter, defaultdict

import regex

from umbra.llm import op5_decontamination as op

ITEMS = [
    (1, "A train travels 120 km in 2 hours. If Anna drives 120 km in 2 hours, how much faster is the train that she saw?"),
    (2, "the quick brown fox jumps over the lazy dog while seven wizards quietly box up their jugs of liquor near home"),
    (3, "short one"),
    (4, None),
    (None, "an item without an id is never looked for in any of these documents at all"),
]


def found(spark, docs, items=ITEMS):
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "9 AS item_id")
    i = spark.createDataFrame(items, "item_id long, text string").selectExpr("*", "'x' AS doc_id")
    return {(r.doc_id, r.item_id): r for r in op.find(d, i).collect()}


def test_slots(spark):
    q = "Some words before. A train travels {a} km in {b} hours. If {n} drives {c} km in {d} hours, how much faster is the train that she saw? And after."
    docs = [
        (1, q.format(a=120, b=2, n="Anna", c=120, d=2)),
        (2, q.format(a=450, b=7, n="Berta", c=450, d=7)),
        (3, q.format(a=450, b=7, n="Berta", c=460, d=9)),  # each repeated number stands for two values
        (4, "A train travels 120 km in 2 hours. " + "Nothing else of it follows here. " * 5),
        (5, None),
        (6, ""),
        (7, "Short: one!"),
        (None, ITEMS[1][1]),
        (8, "x y z " * 40_000 + ITEMS[1][1].upper().replace(" ", ", ") + " end" * 1000),
        (8, "x y z " * 40_000 + ITEMS[1][1].upper().replace(" ", ", ") + " end" * 1000),
    ]
    got = found(spark, docs)
    assert set(got) == {(1, 1), (2, 1), (7, 3), (8, 2), (None, 2)}
    assert got[1, 1].changed_slots == 0 and got[1, 1].containment == 1 and got[2, 1].changed_slots >= 3


def test_against_all_windows(spark):
    rng = random.Random(3)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(300)]
    sentence = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = {k: sentence(rng.randint(9, 70)) for k in range(12)}
    docs = {}
    for d in range(160):
        words = sentence(rng.randint(5, 120))
        if rng.random() < 0.8:
            copy = list(items[rng.randrange(12)])
            for _ in range(rng.randrange(4)):
                at = rng.randrange(len(copy))
                copy[at : at + rng.randrange(2)] = sentence(rng.randrange(1, 3))
            at = rng.randrange(len(words))
            words[at:at] = copy[: rng.choice([len(copy), len(copy), len(copy) - 3])]
        docs[d] = words
    grams = lambda w: [tuple(w[k : k + 5]) for k in range(len(w) - 4)]
    want = set()
    for d, words in docs.items():
        have = set(grams(words))
        want |= {(d, i) for i, w in items.items() if sum(g in have for g in grams(w)) >= 0.8 * len(grams(w))}
    got = found(spark, [(d, " ".join(w)) for d, w in docs.items()], [(i, " ".join(w)) for i, w in items.items()])
    assert len(want) > 40 and set(got) == want


def test_items_full_of_numbers_at_every_offset(spark):
    items = [(1, "A train covers 90 km in 2 hours while another car runs for much longer time"), (2, "add 3 4 5 6 to both sums then 7 8 9 10 11 give the two totals again")]
    docs = [(100 * i + at, "pad " * at + text + " end" * 20) for i, text in items for at in range(40)]
    # Each window of the item by itself, so no two of them stand side by side.
    words = "one two three four five six seven eight nine ten eleven twelve".split()
    items.append((3, " ".join(words)))
    docs += [(300 + at, "pad " * at + " ".join(" ".join(words[k : k + 6]) for k in (0, 2, 4, 6)) + " end" * 20) for at in range(20)]
    assert {x[0] for x in docs} == {d for d, i in found(spark, docs, items) if d // 100 == i}


def plain_tokens(text):
    """(type, value) of the tokens of a text without currency signs, read from left to right; a word's type is itself."""
    out, after = [], False
    for m in regex.finditer(r"\d+(?:[.,]\d+)*|[\p{L}\p{M}%°]+", text):
        word, low = m[0], m[0].lower()
        near = after is not False and regex.fullmatch(r"\s?", text[after : m.start()])
        after = False
        if word[0].isdigit():
            out.append(("n", word.replace(",", ".")))
            after = m.end()
        elif near and low in op._UNITS.split("|"):
            out.append(("u", low))
        elif word[0].isupper() and len(word) > 1 and word[1].islower():
            out.append(("p", low))
        else:
            out.append((None, low))
    return out


def plain_keys(window):
    word = lambda kind, value: ("word", value) if kind is None else (kind, "")
    keys = {tuple(word(k, v) for k, v in window) if any(k is None for k, _ in window) else tuple(window)}
    if any(k == "p" for k, _ in window):
        keys.add(tuple(("word", v) if k == "p" else word(k, v) for k, v in window))
    return keys


def plain_find(docs, items):
    found = {}
    for d, text in docs:
        words = plain_tokens(text or "")
        for i, item in items:
            own = plain_tokens(item or "")
            if not own:
                continue
            n = min(5, len(own))
            count = len(own) - n + 1
            regions = defaultdict(list)
            for x in range(len(words) - n + 1):
                have = plain_keys(words[x : x + n])
                for y in range(count):
                    if have & plain_keys(own[y : y + n]):
                        for step in (len(own) // 2 + 1, len(own) + 1):
                            for band in ((x - y) // step, (x - y) // step - 1):
                                regions[step, band].append((y, x))
            for places in regions.values():
                if len({y for y, _ in places}) < 0.8 * count - 1e-9:
                    continue
                pairs = {(y, x): [(own[y + k], words[x + k]) for k in range(n) if own[y + k][0] and own[y + k][0] == words[x + k][0]] for y, x in places}
                uses = defaultdict(Counter)
                for some in pairs.values():
                    for slot, value in some:
                        uses[slot][value] += 1
                mark = {"n": "1", "p": "2", "u": "3"}
                stands = {slot: max(c, key=lambda v, s=slot, c=c: (c[v], v == s, mark[v[0]] + v[1])) for slot, c in uses.items()}
                good = {y for (y, _), some in pairs.items() if all(stands[s] == v for s, v in some)}
                changed = sum(s != v for s, v in stands.items())
                verbatim = len({v for k, v in own if k is None}) < 3
                if len(good) >= 0.8 * count - 1e-9 and not (verbatim and changed):
                    best = len(good) / count, -changed
                    found[d, i] = max(found.get((d, i), best), best)
    return found


NAMES = "Anna Berta Carlos Dmitri Elif Fatima Goran Hana".split()
QUESTIONS = [
    "{a} has {x} apples and buys {y} kg of pears. {b} gives {a} {x} more, so how many fruits does {a} own now?",
    "A train from {c} covers {x} km in {y} hours. How fast, in mph, would {b} travel if the trip took {z} hours?",
    "{b} paid {x} dollars for {y} litres of milk. What would {z} litres cost {a} at that price?",
    "Add {x} and {y} {z}",
    "Is {c} far?",
    "{x} {y} {z} {x} {y} {z} {x}",
]


def filled(rng, question):
    a, b, c = rng.sample(NAMES, 3)
    return question.format(a=a, b=b, c=c, x=rng.randint(2, 99), y=f"{rng.randint(1, 9)}.{rng.randint(1, 9)}", z=rng.randint(100, 999))


def changed(rng, text):
    """``text`` with other names, numbers and units, each exchanged alike throughout."""
    names = dict(zip(NAMES, rng.sample(NAMES, len(NAMES)), strict=True))
    numbers = defaultdict(lambda: str(rng.randint(1000, 9999)))
    text = regex.sub(r"\d+(?:\.\d+)?", lambda m: numbers[m[0]], text)
    return regex.sub(r"\b(kg|litres|hours)\b", lambda m: {"kg": "lbs", "litres": "gallons", "hours": "minutes"}[m[0]], regex.sub(r"\p{Lu}\p{Ll}+", lambda m: names.get(m[0], m[0]), text))


def test_exchanged_names_numbers_and_units_against_a_plain_version(spark):
    rng = random.Random(11)
    items = [(k, filled(rng, q)) for k, q in enumerate(QUESTIONS)]
    common = "he said the trip to {c} took {x} km and {y} hours before {a} was there. How far? Then {b} paid {z} dollars for {x} litres".split(". ")
    docs, planted, verbatim, neutral = [], set(), set(), set()
    for d in range(240):
        parts = [filled(rng, rng.choice(common)) for _ in range(rng.randint(0, 4))]
        i = rng.randrange(len(items))
        kind = rng.choice(["none", "own", "changed", "changed", "small", "edited"])
        if kind != "none":
            text = items[i][1]
            text = changed(rng, text) if kind in ("changed", "edited") else text.lower() if kind == "small" else text
            if kind == "edited":
                words = text.split()
                words[rng.randrange(len(words)) :][:1] = ["indeed"]
                text = " ".join(words)
            parts.insert(rng.randint(0, len(parts)), text)
            if i < 3 and kind == "changed":
                planted.add((d, i))
            if kind == "own":
                verbatim.add((d, i))
        elif not parts:
            parts = ["nothing"]
        if kind == "none":
            neutral.add(d)
        docs.append((d, rng.choice([" ", ". ", "\n"]).join(parts)))
    got = found(spark, docs, items)
    want = plain_find(docs, items)
    assert {k: (round(r.containment, 9), -r.changed_slots) for k, r in got.items()} == {k: (round(s, 9), c) for k, (s, c) in want.items()}
    recall = len(planted & set(got)) / len(planted)
    assert len(planted) > 30 and recall >= 0.95 and verbatim <= set(got) and not {d for d, _ in got} & neutral


def test_short_and_repeated_items(spark):
    items = [(1, "How many apples does Anna have left now?"), (1, "What is the other text of this same item id?"), (2, "short one"), (3, "Anna 5 km")]
    docs = [
        (1, "before that they ask how many apples does anna have left now and so on"),
        (2, "asked What is the other text of this same item id? yes"),
        (3, "a very short one, it is"),
        (4, "Berta 6 km"),
        (5, "so Anna 5 km"),
        (6, "nothing shorter one"),
        (7, "then How many apples does Berta have left now?"),
    ]
    assert set(found(spark, docs, items)) == {(1, 1), (2, 1), (3, 2), (5, 3), (7, 1)}


def test_clean_and_empty(spark):
    docs = spark.createDataFrame([(1, ITEMS[1][1], "a"), (2, "fine text", "b"), (None, "x", "c"), (2, "fine text", "b")], "doc_id long, text string, lang string")
    items = spark.createDataFrame(ITEMS, "item_id long, text string")
    assert sorted(r.lang for r in op.clean(docs, items).collect()) == ["b", "b", "c"]
    unnamed = spark.createDataFrame([(None, "so " + ITEMS[1][1]), (None, "fine text"), (None, None), (5, "other text"), (5, ITEMS[1][1])], "doc_id long, text string")
    assert Counter(r.text for r in op.clean(unnamed, items).collect()) == {"fine text": 1, None: 1, "other text": 1}
    assert op.clean(docs, items.limit(0)).count() == 4 and op.find(docs.limit(0), items).count() == 0


def test_main_path_has_no_python(spark, monkeypatch):
    plans, cut = [], op.cut
    monkeypatch.setattr(op, "cut", lambda df: plans.append(df._jdf.queryExecution().toString()) or cut(df))
    out = op.find(spark.createDataFrame([(1, ITEMS[1][1])], "doc_id long, text string"), spark.createDataFrame(ITEMS, "item_id long, text string"))
    plans.append(out._jdf.queryExecution().toString())
    assert len(plans) > 3 and not any(x in plan for plan in plans for x in ("Python", "Arrow", "Pandas"))
