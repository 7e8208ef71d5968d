"""Found spans of personal data against a plain reading of the method."""

import random
import re
from math import prod

import pytest

from cohortstats.llm import pii
from tests.llm.test_operators import brute_private

AROUND = "()[]{}<>.,;:!?\"'`*#$%&"


def brute_found(texts, min_seeds, rounds=pii.ROUNDS):
    """Found spans of each text, by dictionaries and one word at a time."""
    norm = lambda t: re.sub(r"[^a-z0-9@.\x80-\U0010ffff]", "", t.lower())
    form = lambda t: re.sub("[0-9]", "0", re.sub("[A-Z]", lambda m: m.group().lower(), t))
    digits = lambda t: len(re.sub("[^0-9]", "", t))
    fills, seeds, induced = [], set(), {}
    for k, text in enumerate(texts):
        spans = [(int(a), int(b)) for _, a, b in (s.split(":") for s in brute_private(text).split(",") if s)]
        at = [m.span() for m in re.finditer(r"[^\x20\t-\r]+", text)]
        word = [text[a:b] for a, b in at]

        def around(f, last, word=word):
            if f >= 2:
                yield "left", form(word[f - 2]), form(word[f - 1])
            if f >= 1 and last + 1 < len(word):
                yield "both", form(word[f - 1]), form(word[last + 1])

        begun, inside = {}, set()
        for a, b in spans:
            f = max(i for i, (s, _) in enumerate(at) if s <= a)
            last = min(i for i, (_, e) in enumerate(at) if e >= b)
            if not text[at[f][0] : a].strip(AROUND):
                seeds.add(norm(text[a:b]))
                for p in around(f, last):
                    induced.setdefault(p, set()).add(norm(text[a:b]))
                if f not in begun or begun[f][1] < b:
                    begun[f] = a, b, last
        for f, (_, _, last) in begun.items():
            inside |= set(range(f + 1, last + 1))
        for f in range(len(at)):
            if f in inside:
                continue
            if f in begun:
                a, b, last = begun[f]
                like = True
            else:
                last = f
                while digits(word[last]) and last + 1 < len(at) and digits(word[last + 1]) and digits("".join(word[f : last + 2])) <= 19:
                    last += 1
                like = digits("".join(word[f : last + 1])) >= 4 or "@" in word[f]
                whole = text[at[f][0] : at[last][1]]
                a = at[f][0] + len(whole) - len(whole.lstrip(AROUND))
                b = a + len(whole.strip(AROUND))
            fills.append((k, a, b, like, norm(text[a:b]) if like else text[a:b].lower(), set(around(f, last))))
    patterns = {p for p, s in induced.items() if len(s) >= min_seeds}
    fills = [(*f[:5], f[5] & patterns) for f in fills]
    belief = {f[4]: float(f[4] in seeds) for f in fills if f[3] and f[5]}
    of = {p: [f for f in fills if p in f[5]] for p in patterns}
    for _ in range(rounds):
        confidence = {p: sum(belief[f[4]] if f[3] else 0 for f in fs) / len(fs) for p, fs in of.items()}
        for i in belief:
            held = {p for f in fills if f[3] and f[4] == i for p in f[5]}
            belief[i] = 1.0 if i in seeds else 1 - prod(1 - min(confidence[p], 0.99) for p in held)
    sure = {p for p, c in confidence.items() if c >= pii.CONFIDENT} if patterns else set()
    everywhere = [w.strip(AROUND).lower() for t in texts for w in re.findall(r"[^\x20\t-\r]+", t)]
    out = [set() for _ in texts]
    for k, a, b, like, i, held in fills:
        if held & sure and a < b:
            if like:
                good = belief[i] >= pii.BELIEVED
            else:
                mine = [f for f in fills if not f[3] and f[4] == i and f[5] & sure]
                trust = 1 - prod(1 - min(confidence[p], 0.99) for p in {p for f in mine for p in f[5] & sure})
                good = trust >= pii.BELIEVED and trust * len(mine) / everywhere.count(i) >= pii.BELIEVED
            if good:
                out[k].add((a, b))
    for k, text in enumerate(texts):
        base = [tuple(map(int, s.split(":")[1:])) for s in brute_private(text).split(",") if s]
        out[k] = sorted(s for s in out[k] if not any(a < s[1] and s[0] < b for a, b in base))
    return out


def found(spark, texts, **more):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    rows = pii.find_personal(d, **more).collect()
    return {r.doc_id: [(s.start, s.end) for s in r.spans if s.rank == 4] for r in rows}


def written(r):
    return r.choice([
        lambda: f"u{r.randint(0, 30)}@ex{r.randint(0, 9)}.org", lambda: f"10.0.{r.randint(0, 9)}.{r.randint(0, 9)}", lambda: "4111 1111 1111 1111", lambda: "5500-0000-0000-0004",
        lambda: f"+1 (555) {r.randint(100, 999)}-{r.randint(1000, 9999)}", lambda: f"{r.randint(100, 999)} {r.randint(10, 99)} {r.randint(1000, 9999)}", lambda: f"nick{r.choice('abcdefgh')}", lambda: "the", lambda: f"id_{r.randint(1000, 1020)}",
    ])()


@pytest.mark.parametrize("seed", range(3))
def test_found_spans_are_those_of_the_method(spark, seed):
    r = random.Random(seed)
    lead = ["mail to", "call me", "my card", "host is", "user of", "it was"]
    texts = []
    for i in range(250):
        k = r.randrange(len(lead))
        strange = r.random() < (0.1, 0.1, 0.15, 0.3, 0.6, 0.9)[k]
        seed_like = [f"u{i}@ex.org", f"+49 30 {1000000 + i}", f"10.1.{i}.7"][k % 3]
        mid = written(r) if strange else seed_like
        texts.append(f"é {r.choice(['the', 'a', 'so'])} {lead[k]} {r.choice(['', '(', '<'])}{mid}{r.choice(['', ',', '.', ')'])} {r.choice(['now', 'or', 'then'])} {r.choice(['the end', 'nicka', '', '12 3'])}")
    want = brute_found(texts, 5)
    got = found(spark, texts)
    assert sum(map(len, want)) > 5
    assert got == {i: v for i, v in enumerate(want)}


def test_names_are_found_and_common_words_are_not(spark):
    texts = [f"please write to u{i}@ex{i}.org today or so" for i in range(60)] + ["please write to Jörg_Nick, today or so", "please write to mother today or so"]
    texts += ["my mother and mother said", "mother, too", "no Jörg here"]
    got = found(spark, texts)
    assert [texts[60][a:b] for a, b in got[60]] == ["Jörg_Nick"] and not any(got[i] for i in range(61, 65)) and not any(got[i] for i in range(60))


def test_slots_hold_whole_numbers(spark):
    texts = [f"card is +1 (555) 200-{1000 + i} thanks for all" for i in range(30)] + ["card is 123 45 6789 thanks for all", "card is 12 thanks for all", "then 123 45 6789 thanks"]
    got = found(spark, texts)
    assert [texts[30][a:b] for a, b in got[30]] == ["123 45 6789"] and got[32] == []
    assert found(spark, texts, patterns=1) == got


def test_one_long_text_of_slots(spark):
    many = " ".join(f"write to u{i}@ex.org today" for i in range(30_000))
    texts = [many + " write to agent_4711 today" * 2000, "12 " * 100_000, "write to agent_4711 today"]
    got = found(spark, texts)
    assert len(got[0]) == 2000 and got[1] == [] and got[2] == [(9, 19)]
