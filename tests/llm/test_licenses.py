import random
import re
import time

from hypothesis import given, settings
from hypothesis import strategies as st

from umbra.llm import op8_licenses as op

INDEX = op.Templates(op.TEMPLATES, {})


def plain(text):
    words = re.findall(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub(rb"[A-Z]", lambda m: m[0].lower(), (text or "").encode()))
    places, labels = [], set()
    for phrase, label in op.PHRASES:
        p = phrase.encode().split()
        for k in range(len(words) - len(p) + 1):
            if words[k : k + len(p)] == p:
                places.append(k)
                labels.add(label)
    return len(words), len(places), min(places, default=None), max(places, default=None), ",".join(sorted(labels))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["MIT", "mit", "license", "License.", "apache", "general", "public", "é", "x-y", "\n", "7", "_", ","]), max_size=25))
def test_places_against_a_plain_version(parts):
    for text in (" ".join(parts), "".join(parts)):
        assert op.scan_text(text, INDEX)[:5] == plain(text)


def spans(index, t, words):
    """(first, last, share) of every run of words that matches a template, by trying all."""
    own, most = index.sets[t], index.most[t]
    for a in range(len(words)):
        for b in range(a, min(len(words), a + most)):
            share = len(own.intersection(words[a : b + 1])) / len(own)
            if share >= op.THRESHOLD - 1e-9:
                yield a, b, share


def test_join_finds_every_block_at_the_threshold():
    rng = random.Random(1)
    small = [x for x in op.TEMPLATES if len(x[1].split()) < 24]
    vocabulary = [w for s in op.Templates(small, {}).sets for w in s] + [b"foo", b"bar", b"baz"]
    found = 0
    for _ in range(300):
        index = op.Templates(small, {w: rng.randrange(4) for w in vocabulary})
        words = []
        for _ in range(rng.randint(1, 5)):
            words += [w for w in op.words_of(rng.choice(small)[1]) for _ in range(rng.choice([0, 1, 1, 1, 1, 1, 2]))]
            words += [rng.choice(vocabulary) for _ in range(rng.randrange(4))]
        got = index.matches(words)
        for m in got:
            own = index.sets[m.template]
            assert m.last - m.first < index.most[m.template] and m.share == len(own.intersection(words[m.first : m.last + 1])) / len(own) >= op.THRESHOLD - 1e-9
        for t in range(len(small)):
            own = [m for m in got if m.template == t]
            want = list(spans(index, t, words))
            assert max((m.share for m in own), default=0) == max((s for *_, s in want), default=0)
            assert all(any(m.share >= s and m.first <= b and a <= m.last for m in own) for a, b, s in want)
            found += len(own)
    assert found > 1000


def wrapped(text, width):
    lines = [""]
    for word in text.split():
        if lines[-1] and len(lines[-1]) + 1 + len(word) > width:
            lines.append("")
        lines[-1] = f"{lines[-1]} {word}".strip()
    return "\n * ".join(lines)


def test_every_template_is_found_at_every_width():
    for frequency in ({}, {w: k % 7 for k, w in enumerate(sorted(INDEX.tokens))}):
        index = op.Templates(op.TEMPLATES, frequency)
        for label, text in op.TEMPLATES:
            for width in (1, 10, 20, 30, 44, 60, 80, 120, 10_000):
                got = op.scan_text(f"Some words come before.\n{wrapped(text, width)}\n\nAnd after it.", index)
                assert label in got[5].split(",") and got[6] == 1, (label, width, got[:7])


def test_labels_of_near_relatives():
    label = lambda text: op.scan_text(text, INDEX)[5]
    for k, (name, text) in enumerate(op.TEMPLATES):
        kin = {"lgpl": "gpl,lgpl", "agpl": "agpl,gpl"}.get(name, name)
        assert label(text) == kin, (k, label(text))
    assert label("Licensed under CC BY 4.0. Licensed under CC BY-SA 4.0.") == "cc-by,cc-by-sa"
    assert {m["label"] for m in op.scan_text("Licensed under CC BY 4.0", INDEX)[7]} == {"cc-by", "cc-by-sa", "cc-by-nc", "cc-by-nd"}
    assert label("") == label("one\n" * 500 + "two") == ""


def test_scattered_words_are_no_match():
    for text in (
        "The doctor, licensed in 2004, worked under the supervision of others for 4 weeks at 0 degrees, followed by a break.",
        "The general public wants a license for every radio, and under the law the set must be licensed for use.",
        "This program is free for the public. You can get it under the terms that the general office has agreed on, and modify it at home.",
    ):
        assert op.scan_text(text, INDEX)[5:7] == ("", 0.0), op.scan_text(text, INDEX)


def test_scan(spark):
    rows = [
        (1, "text\nThis work is licensed under the GNU General Public License, version 3.\nmore"),
        (2, "Licensed under CC BY-NC 4.0."),
        (3, None),
        (3, None),
        (4, "Redistribution and use in source and binary forms,\nwith or without modification,\nare permitted"),
        (5, "word " * 100_000 + "mit license"),
    ]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS score")
    out = {r.doc_id: r for r in op.scan(df).collect()}
    assert (out[1].labels, out[1].base_labels, out[1].first_word, out[1].n_base) == ("gpl", "gpl", 8, 1)
    assert (out[2].labels, out[2].base_labels, out[2].score) == ("cc-by-nc", "", 1.0)
    assert (out[3].n_words, out[3].labels, out[3].score, out[3].first_word) == (0, "", 0.0, None)
    assert out[4].labels == "bsd" and out[5].last_word == 100_000
    assert [(m.label, m.first, m.last, m.share) for m in out[4].matches] == [("bsd", 0, 13, 1.0)]
    assert op.scan(df.limit(0)).count() == 0


def test_time_grows_with_the_length():
    for text in ("the software " * 100_000, op.TEMPLATES[2][1] * 300, "licensed under the gnu " * 50_000):
        begin = time.process_time()
        op.scan_text(text, INDEX)
        assert time.process_time() - begin < 10


def test_ties():
    # Equal shares: of templates of one size both count, else the larger one.
    index = op.Templates([("a", "one two three four"), ("b", "two three four five"), ("c", "one two three four five six")], {})
    assert op.scan_text("one two three four five", index)[5] == "a,b,c"
    assert op.scan_text("one two three four five six", index)[5] == "c"
    assert op.scan_text("one two three four", index)[5] == "a"
    twice = op.Templates([("x", "same words here"), ("y", "same words here")], {})
    assert op.scan_text("same words here", twice)[5] == "x,y"
