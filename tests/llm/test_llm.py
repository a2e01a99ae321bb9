"""The operators for training data against brute force, and what they do with awkward rows."""

from __future__ import annotations

import base64
import quopri
import random
import re

import pytest
from pyspark.sql import functions as F

from manyworlds.llm import leak, mail, mix, names, spam, tokens


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# --- mails -----------------------------------------------------------------------------------------------------------

HEAD = "From: a@b.example\nSubject: x\n"


def multipart(*parts, end="\n--B--\n"):
    return HEAD + 'MIME-Version: 1.0\nContent-Type: multipart/mixed;\n boundary="B"\n\npreamble\n' + "".join(f"--B\n{p}\n" for p in parts) + end


@pytest.mark.parametrize(
    ("text", "body"),
    [
        (None, ""), ("", ""), ("no header here\nsecond", "no header here second"), (HEAD + "\nplain\n> quoted\n", "plain quoted"), (HEAD.replace("\n", "\r\n") + "\r\nplain\r\n", "plain"),
        ("Received: from x\n\t\nFrom: a@b.example\nContent-Transfer-Encoding: quoted-printable\n\nfa=\nr=20away", "far away"),
        (HEAD + "Content-Transfer-Encoding: base64\n\n" + base64.encodebytes("Grüße an alle".encode()).decode(), "grüße an alle"),
        (HEAD + "Content-Transfer-Encoding: base64\n\n" + base64.b64encode(b"cut off somewhere").decode()[:-5], "cut off somewh"),
        (HEAD + "Content-Transfer-Encoding: quoted-printable\n\n" + quopri.encodestring("wie schön".encode()).decode(), "wie schön"),
        (HEAD + "Content-Type: text/html\n\n<style>p{x:1}</style><p>one<b>two</b>&nbsp;three<br>four</p><!-- no --><div style='display:none'>five</div>", "onetwo three four five"),
        (multipart("Content-Type: text/plain\n\nfirst", "Content-Type: application/octet-stream\nContent-Disposition: attachment\n\nsecond", "\nthird"), "first third"),
        (multipart("Content-Type: text/plain\n\nfirst", end=""), "first"), (multipart('Content-Type: multipart/alternative; boundary=C\n\n--C\n\ninner\n--C--'), "inner"),
        (HEAD + "Content-Type: multipart/mixed\n\nno boundary", "no boundary"), (HEAD, ""),
    ],
)
def test_bodies(text, body):
    assert " ".join(re.findall(r"\w+", mail.visible(text).lower())) == body


# --- leaks -----------------------------------------------------------------------------------------------------------


def test_leaks_are_what_brute_force_finds(spark):
    rng = random.Random(1)
    vocabulary = [f"w{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.choice([5, 12, 20, 40])))) for i in range(30)]
    items += [(30, items[3][1]), (31, None), (32, "")]
    docs = []
    for d in range(80):
        text = rng.choices(vocabulary, k=rng.randint(0, 60))
        if d % 2:
            source = items[rng.randrange(30)][1].split()
            n = rng.choice([8, 11, 12, 13, 30])
            at = rng.randint(0, max(0, len(source) - n))
            text[rng.randint(0, len(text)) : 0] = [w.upper() + "," for w in source[at : at + n]]
        docs.append((d, " ".join(text)))
    docs += [(80, None), (81, ""), (82, docs[1][1]), (83, ("pad " * 40_000) + items[2][1])]

    def runs(text, item):
        a, b = leak.words(text), leak.words(item)
        grams = {tuple(b[i : i + 12]) for i in range(len(b) - 11)}
        return any(tuple(a[i : i + 12]) in grams for i in range(len(a) - 11))

    want = {(d, i) for d, t in docs if t for i, x in items if x and runs(t, x)}
    df, it = spark.createDataFrame(docs, "doc_id int, text string").withColumn("item_id", F.lit(1)), spark.createDataFrame(items, "item_id int, text string").withColumn("doc_id", F.lit(1))
    for extra in ({}, {"block_items": 7}):
        got = leak.leaked_items(df, it, body=lambda t: t or "", **extra)
        assert {(r["doc_id"], r["item_id"]) for r in got.collect() if r["longest_run"] >= 12} == want
    assert leak.leaked_items(df, it.limit(0)).count() == 0 and leak.leaked_items(df.limit(0), it).count() == 0


def test_the_multi_index_finds_everything_within_the_radius():
    import numpy as np

    rng = random.Random(2)
    index = leak.PassageIndex([(i, " ".join(rng.choices([f"w{k}" for k in range(400)], k=12))) for i in range(300)], 12, 5, 3, 0.8, 15)
    probes = []
    for p in index.prints:
        flip = 0
        for b in rng.sample(range(64), rng.randint(0, 5)):
            flip |= 1 << b
        probes.append(int(p) ^ flip)
    probes = np.array(probes, np.uint64)
    at, k = index.near(probes)
    want = {(i, j) for i, x in enumerate(probes) for j, y in enumerate(index.prints) if (int(x) ^ int(y)).bit_count() <= 3}
    assert set(zip(at.tolist(), k.tolist())) == want and len(want) > 100


def altered(rng, tokens, every):
    """One word in `every` replaced, at random places."""
    out = list(tokens)
    for at in rng.sample(range(len(out)), len(out) // every):
        out[at] = f"other{rng.randrange(10**6)}"
    return out


def test_item_sized_windows_find_what_brute_force_does(spark):
    rng = random.Random(7)
    vocabulary = ["".join(rng.choices("abcdefghijklmnop", k=rng.randint(2, 9))) for _ in range(3000)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(50, 130)))) for i in range(60)]
    docs = [(d, rng.choices(vocabulary, k=rng.randint(0, 80))) for d in range(240)]
    for d, text in docs:
        text[rng.randint(0, len(text)) : 0] = altered(rng, items[d % 60][1].split(), rng.choice([11, 40, 60, 100]))
    docs = [(d, " ".join(t)) for d, t in docs]

    def best(text, item):
        """The largest weighted similarity of the item and any stretch of its length."""
        grams = lambda t: {tuple(t[i : i + 5]): sum(min(31, len(w)) for w in t[i : i + 5]) for i in range(len(t) - 4)}
        b = grams(item)
        top = 0.0
        for at in range(max(0, len(text) - len(item)) + 1):
            a = grams(text[at : at + len(item)])
            both = sum(w for g, w in a.items() if g in b)
            top = max(top, both / max(1, sum(a.values()) + sum(b.values()) - both))
        return top

    want = {(d, d % 60) for d, t in docs if best(t.split(), items[d % 60][1].split()) >= 0.8}
    df, it = spark.createDataFrame(docs, "doc_id int, text string"), spark.createDataFrame(items, "item_id int, text string")
    got = {(r["doc_id"], r["item_id"]) for r in leak.leaked_items(df, it, body=lambda t: t).filter("similarity >= 0.8 and windows > 0").collect()}
    assert len(want) > 80 and len(want & got) >= 0.9 * len(want) and all(i == d % 60 for d, i in got)
    # One word in ten replaced: beyond 0.8 of five-word shingles, within 0.5 of two-word ones.
    hard = [(d, " ".join(altered(rng, t.split(), 10))) for d, t in items]
    loose = leak.leaked_items(spark.createDataFrame(hard, "doc_id int, text string"), it, body=lambda t: t, shingle=2, similarity=0.5, item_radius=19)
    assert len({r["doc_id"] for r in loose.filter("doc_id = item_id").collect()}) >= 54 and loose.filter("doc_id <> item_id").count() == 0


def test_the_item_index_finds_everything_within_the_radius():
    import numpy as np

    rng = random.Random(3)
    held = leak.ItemWindows(40, [(i, rng.choices([f"w{k}" for k in range(900)], k=40)) for i in range(200)], 5, 15, 0.8, leak.Hasher())
    probes = []
    for p in held.prints:
        flip = 0
        for b in rng.sample(range(64), rng.randint(0, 18)):
            flip |= 1 << b
        probes.append(int(p) ^ flip)
    at, k = held.near(np.array(probes, np.uint64))
    assert set(zip(at.tolist(), k.tolist())) == {(i, j) for i, x in enumerate(probes) for j, y in enumerate(held.prints) if (x ^ int(y)).bit_count() <= 15}


# --- mixing ----------------------------------------------------------------------------------------------------------


def brute_mixture(spark, docs, targets, budget, seed=0):
    """Everything in order, one row at a time."""
    out = []
    for source, share, most in targets:
        own = [d for d in docs if d[1] == source]
        total = 0
        for k in range(1, most + 1):
            keyed = spark.createDataFrame([(d[0],) for d in own], "doc_id bigint").select("doc_id", F.xxhash64("doc_id", F.lit(k), F.lit(seed)).alias("key"))
            size = {d[0]: d[2] for d in own}
            for r in sorted(keyed.collect(), key=lambda r: (r["key"], r["doc_id"])):
                total += size[r["doc_id"]]
                out.append((total / share, source, r["key"], r["doc_id"], k, size[r["doc_id"]]))
    chosen, spent = [], 0
    for finish, source, _, d, k, n in sorted(out):
        spent += n
        if spent > budget:
            break
        chosen.append((d, source, k))
    return sorted(chosen)


@pytest.mark.parametrize("budget", [None, 300, 5000, 10**6])
def test_mixture_is_fair_queueing(spark, budget):
    rng = random.Random(4)
    docs = [(i, rng.choice(["a", "a", "a", "b", "c", None, "z"]), rng.choice([1, 5, 40, 80])) for i in range(150)]
    targets = [("a", 0.2, 1), ("b", 0.5, 3), ("c", 0.3, 2)]
    sized = spark.createDataFrame(docs, "doc_id bigint, source string, tokens bigint").withColumns({c: F.lit("x") for c in ("share", "pass", "key", "slice", "repeats")})
    t = spark.createDataFrame([*targets, ("gone", 0.0, 5)], "source string, target_share double, max_repeats int")
    total = {s: sum(d[2] for d in docs if d[1] == s) for s, *_ in targets}
    limit = budget if budget is not None else int(min(m * total[s] / w for s, w, m in targets))
    got = mix.mixture(sized, t, budget=budget, slice_rows=10)
    assert sorted((r["doc_id"], r["source"], r["pass"]) for r in got.collect()) == brute_mixture(spark, docs, targets, limit)
    report = {r["source"]: r for r in mix.shares(got, t).collect()}
    if budget is None:
        assert all(abs(report[s]["reached_share"] - w) < 0.05 for s, w, _ in targets) and report["gone"]["tokens"] == 0
    assert mix.repeats(got).agg(F.sum("repeats")).first()[0] == got.count()
    finishes = [r["finish"] for r in mix.ordered(got).collect()]
    assert finishes == sorted(finishes)


def test_mixture_of_nothing(spark):
    sized = spark.createDataFrame([(1, "a", 0)], "doc_id bigint, source string, tokens bigint")
    t = spark.createDataFrame([("a", 1.0, 1)], "source string, target_share double, max_repeats int")
    assert mix.mixture(sized, t).count() == 0 and mix.mixture(sized.limit(0), t).count() == 0 and mix.mixture(sized, t.limit(0)).count() == 0


def test_token_counts(spark):
    enc = tokens.encoder()
    long = "the quick brown fox jumps " * 30_000
    assert tokens.token_count(enc, long) == len(enc.encode_ordinary(long))
    rng = random.Random(12)
    for text in (base64.b64encode(rng.randbytes(150_000)).decode(), "".join(rng.choices("ab \n\t1'.é", k=220_000)), "x y  " * 50_000, ("ab" * 60 + "\n") * 2000):
        assert tokens.token_count(enc, text) == len(enc.encode_ordinary(text))
    run = "".join(rng.choices("abcdefgh", k=130_000))
    assert tokens.token_count(enc, "one " + run + " two") == len(enc.encode_ordinary("one")) + len(enc._encode_single_piece(" " + run)) + len(enc.encode_ordinary(" two"))
    df = spark.createDataFrame([(1, "hello world", "s"), (2, None, None), (3, "", "s"), (None, "x", "s")], "doc_id int, text string, source string").withColumn("tokens", F.lit(9))
    assert rows(tokens.sized(df, "doc_id", "text", ["source"])) == [(1, "s", 2), (2, None, 0), (3, "s", 0)]


# --- stuffing --------------------------------------------------------------------------------------------------------

PROSE = "We met the trainer on Monday and talked about the budget for next year. Nobody had read the second report, so the chair explained it again. After lunch the league secretary showed us how the new scoreboard works."
LOG = "\n".join(f"2024-01-{i:02} 10:00:00 level=info svc=api ms={i}" for i in range(1, 25))
TABLE = "player    min   pts\n" + "\n".join(f"Player {i}    {i}    {i * 2}" for i in range(20))


@pytest.mark.parametrize(
    ("text", "flagged"),
    [
        (PROSE, False), (LOG, False), (TABLE, False), ("\n".join(f"#{i} open Report about item {i}" for i in range(20)), False), ("", False), ("\n\n", False),
        ("\n".join(f"https://shop{i}.example/p/{i}" for i in range(15)), True), ("\n".join(f"Cheap Shoes: http://x{i}.example/" for i in range(12)), True),
        (", ".join(["cheap shoes", "buy shoes", "shoes online", "best price"] * 12), True), ("\n".join(["#shoes #cheap #sale #shoes"] * 9), True), (" | ".join(["odds", "bonus", "free bet", "slots"] * 15), True), (" - ".join(["größe 44", "schuhe", "billig", "outlet"] * 15), True),
        ("Shoes cheap online shoes. Cheap shoes for cheap. Online cheap and shoes. " * 10, True), (PROSE + "\n\n" + "http://one.example/a\nhttp://two.example/b", False),
        (PROSE + "\n" + " ".join(["tickets resale courtside"] * 40), True), ("shoes " * 50_000, True),
        ("\n".join(f"{sentence}.\nRead more: https://news.example/{i}" for i, sentence in enumerate(PROSE.split("."))), False),
    ],
)
def test_stuffing(text, flagged):
    assert (spam.part_page(text, False).share() > 0.5) == flagged


def test_notices_and_hidden_text_and_awkward_rows(spark):
    links = "\n".join(f"http://x{i}.example/" for i in range(15))
    notice = "\n\n***\nCONFIDENTIALITY NOTICE: the sender is not liable for loss. " + "Views in it are the writer's own. " * 10
    page = "Content-Type: text/html\n\n<p>Hello there, see you soon.</p><div style='font-size:0'>" + "tickets resale courtside " * 30 + "</div>"
    data = [(1, HEAD + "\n" + links + notice), (2, HEAD + page), (3, None), (4, ""), (5, HEAD + "\n" + PROSE), (5, HEAD + "\n" + PROSE), (1, HEAD + "\n" + links)]
    df = spark.createDataFrame(data, "doc_id int, text string").withColumn("share", F.lit(1))
    assert [r["doc_id"] for r in spam.stuffed_pages(df).orderBy("doc_id").collect()] == [1, 1, 2]
    assert spam.stuffed_pages(df.limit(0)).count() == 0


# --- names -----------------------------------------------------------------------------------------------------------

PERSONS = {
    1: ["Robert van Tufifituzot Sr.", "Bob Tufifituzot, Sr", "TUFIFITUZOT, ROBERT SR.", "van Tufifituzot, Robetr, Sr. (inj.)"],
    2: ["Robert van Tufifituzot III", "Tufifituzot, Robert III", 'Robert "Rob" Tufifitzot III #7'],
    3: ["Zoë Marovekali", "Zoe Marovekali", "Marovekali, Z.", "Marovekali Zoë *", "Coach Zoë B. Marovekali", "Zoë  Marovkeali"],
    4: ["Abigail Marovekali", "Abby Marovekali", "a. marovekali"],
    5: ["Gregory Kelavosun-Dirogepa", "Greg Kelavosun", "Kelavosun Dirogepa, G.K.", "Kelavosun"],
    6: ["Edward Lupinorak", "Ted Lupinorak"],
    7: ["Theodore Sabuvimet", "Ted Sabuvimet"],
}


def test_spellings_of_one_person_are_linked(spark):
    # Common given names in use beside them, so that their places tell what a given name is.
    others = [f"{g} {s}" for g in ("Robert", "Zoë", "Abigail", "Gregory", "Edward", "Theodore") for s in ("Wanutosek", "Pokiduvar", "Fegalonit", "Xurimabos")]
    every = [n for v in PERSONS.values() for n in v] + others + ["TBD", "TBD ", "", " ", "  Zoë Marovekali"]
    df = spark.createDataFrame([(n,) for n in every] + [(None,)], "player string")
    assigned = names.linked(names.spellings((df, "player")))
    got = {(r["player_a"], r["player_b"]) for r in names.variant_pairs(assigned).collect()}
    want = {tuple(sorted((a, b))) for v in PERSONS.values() for a in v for b in v if a != b}
    assert got == want


def test_names_of_nobody(spark):
    empty = spark.createDataFrame([], "spelling string")
    assert names.linked(empty).count() == 0
    df = spark.createDataFrame([("",), ("...",), ("#5 *",), ("x" * 5000,), ("A B",), ("Jr.",)], "spelling string")
    assert names.variant_pairs(names.linked(df)).count() == 0


def test_ambiguous_forms_link_to_nobody(spark):
    df = spark.createDataFrame([("Anders Wanutosek",), ("Andrew Wanutosek",), ("A. Wanutosek",), ("Wanutosek",)], "spelling string")
    assert names.variant_pairs(names.linked(df)).count() == 0


def test_folding_and_slips():
    assert names.fold("Łukáš") == "lukas" and names.fold("Jo5é") == "jose" and names.fold("Ørsted") == "orsted"
    near = lambda a, b: bool({a, *names.slips(a)} & {b, *names.slips(b)})
    assert near("robert", "robetr") and near("robert", "roert") and near("robert", "roberrt") and near("robert", "rovert") and not near("robert", "bortre")


def test_slips_of_short_surnames_need_the_given_name_and_a_far_commoner_word(spark):
    given = ["John", "Mary", "Anna", "Peter", "Laura", "Simon", "Clara", "Oscar", "Helen", "Bruno"]
    common = [f"{g} {s}" for s in ("Smith", "Jones", "Brown", "Lane") for g in given]
    texts = [*common, *(f"{g} Crown" for g in given[:3]), "John Smtih", "Mary Jomes", "Anna Brwn", "Peter Brownn", "J. Smiht", "Zoe Smoth", "Smth"]
    person = {r["spelling"]: r["person"] for r in names.linked(spark.createDataFrame([(t,) for t in texts], "spelling string")).collect()}
    for slip, meant in (("John Smtih", "John Smith"), ("Mary Jomes", "Mary Jones"), ("Anna Brwn", "Anna Brown"), ("Peter Brownn", "Peter Brown"), ("J. Smiht", "John Smith")):
        assert person[slip] == person[meant]
    # No Zoe Smith is there; Crown isn't rare beside Brown.
    assert person["Zoe Smoth"] not in {person[t] for t in common}
    assert person["John Crown"] != person["John Brown"]
    assert len({person[t] for t in common}) == len(common)


def persons_of(spark, texts):
    return {r["spelling"]: r["person"] for r in names.linked(spark.createDataFrame([(t,) for t in texts], "spelling string")).collect()}


def test_second_surnames_and_middle_initials_tell_persons_apart(spark):
    known = [f"{g} {s}" for g in ("Maria", "John", "Laura") for s in ("Wanutosek", "Pokiduvar", "Fegalonit", "Xurimabos")]
    texts = [*known, "Maria Garcia Lopez", "Garcia Lopez, Maria", "Maria Garcia Lpoez", "M. Garcia Lopez", "Maria Garcia Marquez", "Maria Garcia", "John A. Smith", "Smith, John A", "John B. Smith", "John Smith", "Laura C. Kelavosun", "Laura Kelavosun", "L. Kelavosun"]
    person = persons_of(spark, texts)
    assert person["Maria Garcia Lopez"] == person["Garcia Lopez, Maria"] == person["Maria Garcia Lpoez"] == person["M. Garcia Lopez"] != person["Maria Garcia Marquez"]
    assert person["John A. Smith"] == person["Smith, John A"] != person["John B. Smith"]
    assert "Maria Garcia" not in person and "John Smith" not in person  # of several, so of nobody in particular
    assert person["Laura C. Kelavosun"] == person["Laura Kelavosun"] == person["L. Kelavosun"]


def test_organisations_under_their_legal_forms(spark):
    assert names.organisation("The Acme Widgets Co., Ltd.") == ("acmecowidgets", "limited") and names.organisation("Ltd") is None and names.organisation("Jane Acme") is None
    texts = ["Acme Widgets Ltd", "ACME Widgets Limited", "Widgets, Acme Ltd.", "Acme Widgets GmbH", "Tolvane Inc.", "Tolvane, Incorporated", "Tolvane", "John Tolvanes", "Bell & Hart & Co.", "Hart and Bell and Company"]
    person = persons_of(spark, texts)
    assert person["Acme Widgets Ltd"] == person["ACME Widgets Limited"] == person["Widgets, Acme Ltd."] != person["Acme Widgets GmbH"]
    assert person["Tolvane Inc."] == person["Tolvane, Incorporated"] and person["Bell & Hart & Co."] == person["Hart and Bell and Company"]


def test_many_spellings_of_one_person_are_paired_in_pieces(spark):
    texts = [f"spelling {i}" for i in range(names.PIECE + 40)]
    got = names.variant_pairs(spark.createDataFrame([("p", t) for t in texts] + [("q", "a"), ("q", "b"), ("r", "c")], "person string, spelling string"))
    pairs = [(r["player_a"], r["player_b"]) for r in got.collect()]
    assert len(pairs) == len(set(pairs)) == len(texts) * (len(texts) - 1) // 2 + 1


def test_rare_given_names_count_in_large_data_too(spark):
    many = F.translate(F.substring(F.hex(F.xxhash64("id")), 1, 12), "0123456789ABCDEF", "bcdfghjklmnpqrst")
    rare = ["Ulfrida Wanutosek", "Ulfrida Pokiduvar", "Ulfrida Fegalonit", "Wanutosek Ulfrida", "Pokiduvar, Ulfirda"]
    df = spark.range(90_000).select(F.concat(F.lit("Robert "), many).alias("spelling")).union(spark.createDataFrame([(t,) for t in rare], "spelling string"))
    person = {r["spelling"]: r["person"] for r in names.linked(df.distinct()).filter(F.col("spelling").isin(rare)).collect()}
    assert person["Wanutosek Ulfrida"] == person["Ulfrida Wanutosek"] and person["Pokiduvar, Ulfirda"] == person["Ulfrida Pokiduvar"]


def test_all_words_that_reading_asks_for_are_looked_up():
    class Asked(names.Vocabulary):
        def meanings(self, word):
            asked.add(word)
            return super().meanings(word)

    vocabulary = Asked({"robert": 9, "mckenna": 5, "zoe": 4})
    for text in [t for own in PERSONS.values() for t in own] + ["McKenna, Zoe (Bob)", "mckenna zoe", "Mc Tavish McTavish-McKenna R.", 'Dr. Zoë "Mcbob" O\'Neil,Jr.', "a\xa0b, Anne-Marie/Lee #4", ""]:
        asked: set[str] = set()
        names.read_name(text, vocabulary)
        assert {w for w in asked if len(w) > 1} <= names.asked_words(text)


def test_roots_of_roots_are_followed_to_the_end(spark):
    chain = ["abcdefghijkl"[:i] + "mnopqrstuvwx"[i:] for i in range(12)]  # each one letter from the next
    uses = [(w,) for i, w in enumerate(chain) for _ in range(1 + 3 * i)]
    roots = names.surname_roots(spark.createDataFrame(uses, "word string"))
    assert {(r["word"], r["root"]) for r in roots.collect()} == {(w, chain[-1]) for w in chain}


def prose(rng, n):
    """Sentences of words that hardly come again."""
    return " ".join(" ".join("".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(3, 9))) for _ in range(11)).capitalize() + "." for _ in range(n // 11))


def test_the_body_is_judged_as_a_whole():
    rng = random.Random(9)
    links = "\n".join(f"http://x{i}.example/a" for i in range(5))
    long, short = prose(rng, 330), "buy cheap shoes cheap boots cheap shoes buy boots shoes buy cheap boots " * 20
    plain = lambda t: f"Content-Type: text/plain\n\n{t}"
    assert spam.mail_page(multipart(plain(long), plain(links))).share() < 0.1
    assert spam.mail_page(multipart(plain(long), plain(short * 3))).share() > 0.5
    other = HEAD + 'Content-Type: multipart/alternative; boundary="B"\n\n' + f"--B\n{plain('See you on Sunday.')}\n--B\nContent-Type: text/html\n\n<p>See you on Sunday.</p><div style='display:none'>{short}</div>\n--B--\n"
    assert spam.mail_page(other).share() > 0.5
    assert spam.mail_page(None).share() == spam.mail_page("").share() == spam.mail_page(multipart()).share() == 0


def test_prose_that_is_quoted_again_is_no_repetition():
    rng = random.Random(10)
    paragraph = prose(rng, 33)
    lines = "\n".join(paragraph[i : i + 60] for i in range(0, len(paragraph), 60))
    quoted = "\n\n".join("\n".join("> " * k + line for line in lines.split("\n")) for k in range(4))
    assert spam.part_page(quoted, False).share() == 0
    assert spam.part_page("\n\n".join(["cheap shoes buy boots online"] * 30), False).share() > 0.5


def test_deeply_nested_parts():
    inner = "Content-Type: text/plain\n\nat the bottom"
    for k in range(200):
        inner = f'Content-Type: multipart/mixed; boundary="b{k}"\n\n--b{k}\n{inner}\n--b{k}--\n'
    assert mail.visible(inner).strip() == "at the bottom"


def test_strung_terms_need_no_repetition():
    rng = random.Random(11)
    word = lambda: "".join(rng.choices("abcdefghijklmnoprstuvw", k=rng.randint(4, 9)))
    terms = "\n".join(", ".join(f"{word()} {word()}" for _ in range(5)) for _ in range(6))
    assert spam.part_page(terms, False).share() > 0.5
    assert spam.part_page(terms + "\n\n" + prose(rng, 44), False).share() == 0
    assert spam.part_page(", ".join(word() for _ in range(8)), False).share() == 0
