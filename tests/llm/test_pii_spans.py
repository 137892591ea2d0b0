"""Added personal data on frames that training lacks: neighbours of one kind, by kind, and texts that hold none."""

import random

from learntrail.llm import pii

NAMES = ["Olga Petrova", "Tom Hardy", "Nadia Benali", "Erik Larsson", "Chloe Martin", "Kurt Wagner"]
FOUND = {
    "phone": (["555-{a}-{b}", "(555) {a}-{b}", "555.{a}.{b}"], ["ring {x} tomorrow", "call us: {x}", "phone {x}, fax {y}", "call {x} {y}", "tel. {x}, {y} or come", "his phone is {x} {y}"]),
    "ssn": (["{a}-45-{b}", "{a} 45 {b}"], ["ssn {x}", "the SSN: {x} was lost", "ssn {x} {y}", "social security number {x}, {y}"]),
    "name": (NAMES, ["Dear {x}, thanks a lot", "Sincerely, {x}", "contact {x}, {y}", "my name is {x}", "Mrs. {x} is here", "regards, {x}, {y}", "Herr {x} kommt heute"]),
    "email": (["jo{a} at host{b} dot org", "jo{a} (at) host{b} (dot) net", "jo{a}(at)host{b}(dot)com"], ["mail {x} for it", "email: {x}", "write to {x}"]),
    "secret": (["4f9a{a}c0de77b1e2{b}aa03", "sk-{b}abcdef0123{a}9876"], ["password: {x}", "the token = {x} leaked", "key: {x} here"]),
}


def spans(decoder, text):
    labels = decoder.decode([text.split()])[0]
    return {(k, text[a:b]) for k, a, b in pii.added_spans(text, labels, pii.base_spans(text))}


def test_recall_and_precision_by_kind():
    decoder, rng = pii.Decoder(pii.trained()), random.Random(7)
    for kind, (values, frames) in FOUND.items():
        found = planted = wrong = 0
        for frame in frames:
            for _ in range(20):
                x, y = (rng.choice(values).format(a=rng.randrange(100, 999), b=rng.randrange(1000, 9999)) for _ in "xy")
                text = frame.format(x=x, y=y)
                want, got = {(kind, v) for v, slot in ((x, "{x}"), (y, "{y}")) if slot in frame}, spans(decoder, text)
                planted, found, wrong = planted + len(want), found + len(want & got), wrong + len(got - want)
        assert found >= 0.8 * planted and wrong <= 0.1 * planted, (kind, found, planted, wrong)


def test_neighbours_of_one_kind_are_two_spans():
    decoder = pii.Decoder(pii.trained())
    assert spans(decoder, "call 555-123-4567 555-987-6543") == {("phone", "555-123-4567"), ("phone", "555-987-6543")}
    assert spans(decoder, "call 555-123-4567, 555-987-6543 now") == {("phone", "555-123-4567"), ("phone", "555-987-6543")}
    assert spans(decoder, "ssn 123-45-6789 078-05-1120") == {("ssn", "123-45-6789"), ("ssn", "078-05-1120")}
    assert spans(decoder, "contact John Smith, Mary Brown") == {("name", "John Smith"), ("name", "Mary Brown")}


def test_a_span_without_form_gives_its_fitting_words():
    labels = [pii.LABELS.index(x) for x in ("O", "name", "+name", "+name")]
    assert pii.added_spans("call x Jane y", labels, []) == [("name", 7, 11)]
    assert pii.added_spans("call x Jane y", labels, [("ip", 8, 9)]) == []


def test_plain_texts_hold_none():
    decoder = pii.Decoder(pii.trained())
    for text in ("Die Berliner Mauer und der Hund", "the Great River and Old Town", "For For For For For", "By.&&& Tiinat.%%% Nted*** it", "Licensed under the Apache License, Version 2.0.", "Onou Onou Onou Onou Onou", "1234 5678 9012 345", ""):
        assert spans(decoder, text) == set(), text


def test_long_words_differ_by_their_tails():
    assert pii.features("a-b" * 20 + "1" * 3) != pii.features("a-b" * 200 + "1" * 3)
