"""The training-data operators on small inputs: nulls, ties, repeats, empty tables, extra columns, brute force."""

import collections
import itertools
import random
import re
import unicodedata
from pathlib import Path

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from glossaflow.llm import copies, languages, leakage, lookalikes, markup, mixture, pairs, quota, sampling, tiling


# --- p1 -----------------------------------------------------------------------------------------------------------------
O = "Ο τεχνικός πλήρωσε 40 € στη σελ. 12, και είπε «λυπάμαι, δεν μπορώ»."  # noqa: E741
GOOD = "Ο τεχνικός πλήρωσε σαράντα ευρώ στη σελίδα δώδεκα, και είπε «λυπάμαι, δεν μπορώ»."


@pytest.mark.parametrize(
    ("original", "answer", "defect"),
    [
        (O, GOOD, None), (O, f"«{GOOD}»", None), (O, f"```\n{GOOD}\n```", None), (O, f"Έξοδος: {GOOD.upper()}", None), (O, GOOD.rstrip("."), None),
        (O, None, "empty"), (O, "", "empty"), (O, " ​\n", "empty"), (O, "N/A", "empty"), (O, "Απάντηση:", "empty"), (O, "«»", "empty"), (O, "```\n```", "empty"), (O, "...", "empty"),
        (O, O, "copy"), (O, O.upper(), "copy"), (O, f"Output: {O}", "copy"), ("Απλό κείμενο χωρίς τίποτα.", "Απλό κείμενο χωρίς τίποτα.", None), ("ΟΛΑ ΚΕΦΑΛΑΙΑ ΕΔΩ", "ΟΛΑ ΚΕΦΑΛΑΙΑ ΕΔΩ", None),
        ("Μέλος του ΟΦΕ εδώ", "μέλος του οφε εδώ", "copy"),
        (O, "Συγγνώμη, δεν είναι δυνατόν να απαντήσω.", "refusal"), (O, "As a language model, I must decline.\n" + O, "refusal"), (O, "I can’t process this request.", "refusal"), (O, "Je ne peux pas répondre.", "refusal"),
        (O, "The engineer paid forty euros on page twelve.", "other_language"), (O, "Απάντηση: The engineer paid.", "other_language"),
        (O, GOOD[:40], "truncated"), (O, "Ο τεχνικός πλήρωσε.", "truncated"), ("Κοστίζει 345 €.", "Κοστίζει τριακόσια σαράντα ευρώ.", "truncated"), ("Κοστίζει 345 €.", "Κοστίζει τριακόσια σαράντα πέντε ευρώ.", None),
        ("Στις 3:29.", "Στις τρεις και είκοσι.", "truncated"), ("Στις 3:29.", "Στις τρεις και είκοσι εννέα.", None), ("Του φορέα ΟΦΕ.", "Του φορέα Οργανισμός Φωνητικής.", "truncated"), ("Του φορέα ΟΦΕ.", "Του φορέα Οργανισμός Φωνητικής Έρευνας.", None),
        (None, "κάτι", None), ("", "", "empty"),
    ],
)
def test_judge(original, answer, defect):
    assert pairs.judge(original, answer)[0] == defect


def test_parser():
    assert markup.parse_markup("```text\n«α [β").open_at_end == ["fence", "«", "["]
    assert markup.parse_markup("- Έξοδος: “α”").text == "α" and markup.parse_markup("**Απάντηση:** <b>«α»</b>").text == "α"
    assert markup.parse_markup("1. α\n2. β").text == "1. α\n2. β" and markup.parse_markup("1. α\n2.").open_at_end == ["item"]
    assert markup.parse_markup("«α» και «β»").text == "«α» και «β»" and markup.parse_markup("«α «β» γ»").text == "α «β» γ"
    assert markup.parse_markup("α <b>β <i").open_at_end == ["tag", "tag"] and markup.parse_markup("α <br> 3 < 4").open_at_end == []
    assert markup.parse_markup("α (β»)").open_at_end == [] and markup.parse_markup("").text == ""
    assert len(markup.parse_markup("λέξη (α «β " * 20_000).open_at_end) == 40_000 and markup.parse_markup("(α «β] γ”) δ").open_at_end == []
    assert markup.parse_markup("«" * 5000 + "α" + "»" * 5000).text == "α" and len(markup.parse_markup("(" * 3000).open_at_end) == 3000


def brute_tiles(a, b):
    free_a, free_b, tiles = [True] * len(a), [True] * len(b), []
    while True:
        best, found = 1, []
        for i, j in itertools.product(range(len(a)), range(len(b))):
            k = 0
            while i + k < len(a) and j + k < len(b) and free_a[i + k] and free_b[j + k] and a[i + k] == b[j + k]:
                k += 1
            if k > best:
                best, found = k, [(i, j)]
            elif k == best:
                found.append((i, j))
        if best < 2:
            return sorted(tiles)
        for i, j in found:
            if all(free_a[i : i + best]) and all(free_b[j : j + best]):
                free_a[i : i + best] = free_b[j : j + best] = [False] * best
                tiles.append((i, j, best))


def test_tiles_match_brute_force():
    a, b = "α β γ δ ε ζ".split(), "δ ε ζ x α β γ".split()
    assert tiling.greedy_tiles(a, b) == [(0, 4, 3), (3, 0, 3)] and tiling.greedy_tiles([], b) == []
    rng = random.Random(3)
    for _ in range(300):
        v = "abcd"[: rng.randint(1, 4)]
        a, b = rng.choices(v, k=rng.randint(0, 25)), rng.choices(v, k=rng.randint(0, 25))
        assert tiling.greedy_tiles(a, b) == brute_tiles(a, b)


def test_tiles_of_long_texts():
    long = [f"w{i % 700}" for i in range(30000)]
    assert tiling.greedy_tiles(long, long) == [(0, 0, 30000)]
    a = [w for i in range(3000) for w in ("α", "β", f"x{i}")]
    b = [w for i in range(3000) for w in ("α", "β", f"y{i}")]
    tiles = tiling.greedy_tiles(a, b)
    assert len(tiles) == 3000 and all(k == 2 for _, _, k in tiles) and all(a[i : i + k] == b[j : j + k] for i, j, k in tiles)
    assert len(tiling.greedy_tiles(["α"] * 20000 + ["x"], ["α"] * 20000 + ["y"])) == 1


ODD = ["α", "ΟΗΕ", "5", "12:30", "3/4", "€", "%", " ", "\n", "(", ")", "«", "»", '"', "```", "**", "<b>", "</b>", "<", "- ", "1. ", ".", "…", "δεν μπορώ", "λυπάμαι", "π.χ.", "ǅ", "İ", "\u0301", "\x00", "🙂", "Απάντηση:", "₂", "٣", "Ⅷ", "2,20 €", "1.234"]


@given(st.lists(st.sampled_from(ODD), max_size=12), st.lists(st.sampled_from(ODD), max_size=12))
@settings(max_examples=300, deadline=None)
def test_odd_texts_are_judged(original, answer):
    for o, a in (("".join(original), "".join(answer)), (" ".join(original), " ".join(answer))):
        assert pairs.judge(o, a)[0] in (None, "empty", "refusal", "other_language", "copy", "truncated")
        leakage.plain_words(o)
        assert all(0 <= x < y <= len(o) for x, y in languages.sentences(o))


# Each row is judged right only with the tiles or the parser's stack; the second test holds that.
BY_TILES = [("Είδε τον μεγάλο παλιό φάρο και μετά γύρισε στον φάρο.", "Είδε τον φάρο και μετά γύρισε στον φάρο.", None), ("Έγραψε στον καλό και μόνο φίλο, ύστερα στον φίλο του φίλο", "Έγραψε στον φίλο, ύστερα στον φίλο του φίλο", None)]
BY_STACK = [
    ("Ο φορέας ήρθε στις 5 χθες.", "Ο φορέας (ήρθε στις πέντε χθες", "truncated"), ("Είπε «έλα στις 5» και φύγε 5", "Είπε «να ρθει μόνος του κάπου πέντε", "truncated"),
    ("Πήγε στις 5 η Ζωή, ύστερα η Ζωή", "Πήγε στις πέντε η <b>Ζωή, ύστερα η Ζωή", "truncated"), ("Ο φορέας ήρθε χθες.", "Ο φορέας [ήρθε] (σαν χθες", "truncated"),
]


@pytest.mark.parametrize(
    ("original", "answer", "defect"),
    [
        ("Είδε τον φάρο, μετά το λιμάνι και ξανά τον φάρο.", "Είδε τον φάρο", "truncated"), ("Είδε 5 φάρους (στα 12 νησιά).", "Είδε πέντε φάρους (στα δώδεκα νησιά", None), ("Είδε 5 φάρους.", "```\nΕίδε πέντε φάρους.", None),
        ("Δώσε μου 5 λεπτά", "Δεν μου επιτρέπεται να το κάνω αυτό", "refusal"), ("Δώσε μου 5 λεπτά", "Δεν θα το έλεγα, πέντε λεπτά", None), *BY_TILES, *BY_STACK,
        ("Η αποθήκη είναι του φορέα ΣΠΗΛ απέναντι, με τη στήριξη του φορέα ΣΠΗΛ.", "Η αποθήκη είναι του φορέα Σύλλογος Πειραματικής Ηχολογίας απέν", "truncated"),
        ("Δυστυχώς το πλοίο έφυγε στις 5.", "Unfortunately the ship left at five.", "other_language"), ("Το πλοίο έφυγε στις 5.", "Λυπάμαι για την αναμονή σας, ίσως κάποια άλλη φορά να τα καταφέρουμε μαζί όπως θα θέλατε κι εσείς.", "refusal"),
    ],
)
def test_what_decides(original, answer, defect):
    assert pairs.judge(original, answer)[0] == defect


def test_tiles_and_stack_decide(monkeypatch):
    monkeypatch.setattr(pairs, "greedy_tiles", lambda a, b: [])
    assert all(pairs.judge(o, a)[0] != d for o, a, d in BY_TILES)
    monkeypatch.undo()
    bare = lambda text: markup.Markup(markup.parse_markup(text).text)
    monkeypatch.setattr(pairs, "parse_markup", bare)
    assert all(pairs.judge(o, a)[0] != d for o, a, d in BY_STACK)


@pytest.mark.parametrize(
    ("phrase", "refusal"),
    [
        ("«δεν μπορώ άλλο»", "Δεν μπορώ να επεξεργαστώ αυτό το κείμενο."), ("«λυπάμαι, δεν μπορώ απόψε»", "Λυπάμαι, δεν μπορώ να βοηθήσω."), ("«λυπάμαι, δεν μπορώ»", "Λυπάμαι, δεν μπορώ."),
        ("«δεν μπορώ να απαντήσω»", "Συγγνώμη, αλλά δεν μπορώ να το κάνω"), ("«i cannot stay»", "This request cannot be completed."), ("«δεν επιτρέπεται να απαντήσω»", "Ως γλωσσικό μοντέλο, δεν επιτρέπεται να το αλλάξω"),
    ],
)
def test_refusal_of_an_original_with_refusing_words(phrase, refusal):
    original = f"Ο φύλακας είπε {phrase} στη σελ. 12, πριν φύγει από το email του σταθμού."
    good = original.replace("σελ. 12", "σελίδα δώδεκα")
    assert pairs.judge(original, refusal)[0] == pairs.judge(original, f"{refusal}\n{original}")[0] == "refusal"
    for sound in (good, good.upper(), good.replace("«", "").replace("»", ""), good.replace("email", "ιμέιλ")):
        assert pairs.judge(original, sound)[0] is None
    assert pairs.judge(original, good[: good.index("»") - 1])[0] == "truncated"
    short = f"{phrase} είπε στις 12."
    assert pairs.judge(short, short.replace("12", "δώδεκα"))[0] is None
    assert pairs.judge(short, f"{refusal} Ευχαριστώ.")[0] == "refusal"


@pytest.mark.parametrize(
    ("number", "whole", "cut"),
    [
        ("22,2", "είκοσι δύο κόμμα δύο", "είκοσι δύο"), ("4:04", "τέσσερις και τέσσερα", "τέσσερις"), ("4:45", "πέντε παρά τέταρτο", "τέταρτο"), ("16:30", "τεσσερισήμισι", "τέσσερις"), ("3:00", "τρεις ακριβώς", "στις"),
        ("5/5/2005", "πέντε Μαΐου δύο χιλιάδες πέντε", "πέντε"), ("3,05", "τρία κόμμα μηδέν πέντε", "τρία"), ("3/4", "τρία τέταρτα", "τρία"), ("1.234,4", "χίλια διακόσια τριάντα τέσσερα κόμμα τέσσερα", "χίλια διακόσια τριάντα τέσσερα"),
        ("2,2 %", "δύο κόμμα δύο τοις εκατό", "δύο"), ("2,20 €", "δύο ευρώ και είκοσι λεπτά", "δύο ευρώ"), ("12.12.2012", "δώδεκα δωδεκάτου δύο χιλιάδες δώδεκα".replace("δωδεκάτου", "Δεκεμβρίου"), "δώδεκα"),
    ],
)
def test_all_parts_of_a_number(number, whole, cut):
    assert pairs.judge(f"Το σημείωσαν ως {number}.", f"Το σημείωσαν ως {whole}.")[0] is None
    assert pairs.judge(f"Το σημείωσαν ως {number}.", f"Το σημείωσαν ως {cut}")[0] == "truncated"


REPEATED = "Η χορωδία διάβασε χάρτες και άλλα κείμενα, π.χ. παραμύθια έξω από το χωριό, καθώς πλησίαζε το τρένο των 12 και άλλα κείμενα, π.χ. παραμύθια."


def test_stops_at_earlier_place_that_ends_alike():
    whole = REPEATED.replace("π.χ.", "παραδείγματος χάρη").replace("12", "δώδεκα")
    assert pairs.judge(REPEATED, whole)[0] is None
    assert pairs.judge(REPEATED, whole[: whole.index("παραμύθια") + 9])[0] == "truncated"
    assert pairs.judge("Σελίδα 12 από τις 12", "Σελίδα δώδεκα")[0] == "truncated" and pairs.judge("Σελίδα 12 από τις 12", "Σελίδα δώδεκα από τις δώδεκα")[0] is None
    assert pairs.judge("Πλήρωσε 45 ευρώ για τα 5", "Πλήρωσε σαράντα πέντε")[0] == "truncated"
    text = " ".join(f"λέξη{'αβγδεζηθικ'[i % 10]}{'αβγδεζηθικ'[i // 10 % 10]}" for i in range(4000)) + " στις 12 λέξηαα"
    assert pairs.judge(text, text.replace("12", "δώδεκα"))[0] is None and pairs.judge(text, text[: text.index(" λέξηβα")])[0] == "truncated"


def test_open_constructs_decide_where_alignment_does_not():
    original, answer = "Είπε «έλα στις 5» και φύγε 5", "Είπε «να ρθει μόνος του κάπου πέντε"
    assert pairs.judge(original, answer)[0] == "truncated" and pairs.judge(original, answer + "»")[0] is None
    assert pairs.judge(original, "Είπε «έλα στις πέντε και φύγε πέντε")[0] is None


def test_pairs_table(spark):
    schema = "dataset_id string, id string, original_text string, normalized_text string, normalization_warnings array<string>, ingested_at timestamp, defect string, row int"
    import datetime as dt

    t = [dt.datetime(2025, 1, d) for d in (1, 2)]
    rows = [
        ("d", "1", O, O, ["empty output"], t[0], "x", 1), ("d", "1", O, GOOD, None, t[1], "x", 1), ("d", "2", O, O, ["possible refusal/meta text: 'x'"], None, None, 2),
        ("d", "3", O, O, ["output too short (ratio 0.1)"], t[0], None, 3), ("d", "4", O, O, [], t[0], None, 3), ("d", "5", O, O, ["output too long"], t[0], None, 3), ("d", "6", O, None, [None], t[0], None, 3), (None, "7", O, GOOD, None, None, None, 3),
    ]
    df = spark.createDataFrame(rows + rows[2:4], schema)
    got = {(r.dataset_id, r.id): r.defect for r in pairs.defective_pairs(df).collect()}
    assert got == {("d", "2"): "refusal", ("d", "3"): "truncated", ("d", "4"): "copy", ("d", "5"): "copy", ("d", "6"): "empty"}
    assert pairs.defective_pairs(df.limit(0)).count() == 0
    assert pairs.judge("α " * 20000, "α " * 20000)[0] is None


# --- p2 -----------------------------------------------------------------------------------------------------------------
def brute_key(text):
    low = text.lower().replace("ς", "σ")

    def bare(t):
        out = []
        for m in re.finditer(r"[^\W_]|[^\w]+|_+", unicodedata.normalize("NFC", t)):
            s = m.group()
            between = 0 < m.start() and m.end() < len(t) and t[m.start() - 1].isdigit() and t[m.end()].isdigit()
            out.append(s if s.isalnum() or (between and not re.search(r"\s", s)) else "")
        return "".join(out)

    for sep in (r"[|;/•\n]+", r"[|;/•\n,]+"):
        parts = [p for p in re.split(sep, low) if bare(p)]
        if len(parts) > 1 and all(re.fullmatch(r"\W*[^\W\d_]\w*(?: \w+){0,3}\s*:\s*[^\s:][^:]*", p.strip()) for p in parts):
            return "F" + "|".join(sorted(bare(p.split(":", 1)[0]) + "=" + bare(p.split(":", 1)[1]) for p in parts))
    return bare(low)


TEXTS = [
    "Ο φάρος έλαμψε.", "ο  ΦΆΡΟΣ, έλαμψε!", "«Ο φάρος έλαμψε»", "Ο φαρος έλαμψε.", "έλαμψε ο φάρος", "με 5,6 ώρες", "με 56 ώρες", "με 5.6 ώρες", "ΜΕ 5,6 ΏΡΕΣ", "με 5, 6 ώρες",
    "Τόπος: Α | Έτος: 1942", "έτος: 1942; τόπος: α", "Έτος : 1942\nΤόπος:\tΑ.", "Τόπος: 1942 | Έτος: Α", "Τόπος: Α, Έτος: 1942", "στις 3:11", "στις 311", "στις 3:11.", "Στις 3:11, ναι", "x" * 5000, "X" * 5000 + "!",
]


def test_canonical_matches_brute_force(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "i int, t string").select("i", copies.canonical(F.col("t")).alias("k"))
    groups = collections.defaultdict(set)
    for r in df.collect():
        groups[r.k].add(r.i)
    want = collections.defaultdict(set)
    for i, t in enumerate(TEXTS):
        want[brute_key(t)].add(i)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_marks_inside_values_of_fields(spark):
    groups = [
        ["Ώρα: 10:41 | Τόπος: Χ", "τόπος: Χ; ώρα: 10:41", "Τόπος: Χ, Ώρα: 10:41."], ["Ώρα: 1041 | Τόπος: Χ"], ["Ώρα: Χ | Τόπος: 10:41"],
        ["Ημερομηνία: 12/5/2024 | Πηγή: https://a.gr/β?γ=1", "Πηγή: https://a.gr/β?γ=1 / Ημερομηνία: 12/5/2024", "• Πηγή: https://a.gr/β?γ=1\n• Ημερομηνία: 12/5/2024"], ["Ημερομηνία: 12/52024 | Πηγή: https://a.gr/β?γ=1"],
        ["Τόπος: Α; Β | Έτος: 1942, Μήνας: 5", "Έτος: 1942 | Μήνας: 5 | Τόπος: Α; Β"], ["Ένα δύο τρία τέσσερα πέντε: α | Έτος: 1", "Έτος: 1; ένα δύο τρία τέσσερα πέντε: α"],
    ]
    rows = [(n, t) for n, group in enumerate(groups) for t in group]
    keys = spark.createDataFrame(rows, "n int, t string").groupBy("n").agg(F.collect_set(copies.canonical(F.col("t"))).alias("k")).collect()
    assert all(len(r.k) == 1 for r in keys) and len({r.k[0] for r in keys}) == len(groups)


def test_trie_against_counter():
    rng, trie, want = random.Random(1), copies.CountingTrie(), collections.Counter()
    for _ in range(3000):
        key = bytes(rng.choices(b"ab", k=rng.randint(0, 12)))
        trie.add(key, 1, str(len(key)))
        want[key] += 1
    assert {k: n for k, n, _ in trie.items()} == dict(want)


@pytest.mark.parametrize("bucket_bytes", [1, 64, 1 << 20])
def test_collapse_and_links(spark, bucket_bytes):
    rng = random.Random(2)
    rows = [(f"i{n:04d}", rng.choice(TEXTS), n % 3, "extra") for n in range(400)] + [(f"h{n:04d}", TEXTS[0], 1, None) for n in range(200)] + [(None, "α", 1, None), ("n1", None, 1, None), ("n2", "...", 1, None), ("n3", "", 1, None)]
    rows += rows[:50]
    df = spark.createDataFrame(rows, "id string, text string, ingested_at int, digest string").repartition(5)
    want = collections.defaultdict(set)
    for i, t, *_ in rows:
        if i:
            want[(t and brute_key(t)) or (i,)].add(i)
    got = {(r.kept_id, r.n_copies) for r in copies.collapsed_records(df, "id", "text", "ingested_at", bucket_bytes).collect()}
    assert got == {(min(g), len(g)) for g in want.values()}
    links = {(r.kept_id, r.copy_id) for r in copies.copy_links(df, "id", "text", "ingested_at", bucket_bytes).collect()}
    assert links == {(min(g), i) for g in want.values() for i in g if i != min(g)}
    assert copies.copy_links(df.limit(0), "id", "text", "ingested_at").count() == 0


def test_buckets_fit(spark):
    """Prefixes of 10,000 kinds, in buckets of 4 KiB: every one fits, and no key is lost or split."""
    rng = random.Random(8)
    keys = [f"{i % 10_000:05d}" * 3 + "".join(rng.choices("abc", k=rng.randint(0, 40))) for i in range(60_000)] + ["00001" * 3 + "x" * 400 + str(i) for i in range(3000)] + ["z" * 700] * 50
    partial = spark.createDataFrame([(k.encode(), 1, str(n)) for n, k in enumerate(keys)], "key binary, n bigint, kept_id string").repartition(6).persist()
    levels, depth = copies.radix_levels(partial, 4096)
    parted = copies.with_bucket(partial, levels, depth)
    sizes = parted.groupBy("bucket").agg(F.sum(F.length("key")).alias("size"), F.countDistinct("key").alias("n")).collect()
    assert len(levels) > 6 and max(d for d, _ in levels) >= 256 and all(r.size <= 4096 or r.n == 1 for r in sizes)
    assert parted.groupBy("key").agg(F.countDistinct("bucket").alias("n")).filter("n > 1").count() == 0 and parted.count() == len(keys)
    assert any(r.size > 4096 for r in sizes)  # one key too often to fit: nothing to split, and one node in its trie


def test_latest_delivery_counts(spark):
    df = spark.createDataFrame([("a", "ένα", 1), ("a", "δύο", 2), ("b", "ένα", 1), ("c", "δύο", None)], "id string, text string, at int")
    assert copies.copy_links(df, "id", "text", "at").collect() == [("a", "c")]


# --- p3 -----------------------------------------------------------------------------------------------------------------
def test_sample_is_stable(spark):
    df = spark.createDataFrame([(f"id{i % 900}", i) for i in range(1000)] + [(None, 1), ("", 2)], "id string, unit int")
    first = {r.id for r in sampling.stable_sample(df, "id", 0.2, "s").collect()}
    again = {r.id for r in sampling.stable_sample(df.repartition(9), "id", 0.2, "s").collect()}
    more = spark.createDataFrame([(f"new{i}", i) for i in range(500)], df.schema)
    grown = {r.id for r in sampling.stable_sample(df.union(more), "id", 0.2, "s").collect()}
    wider = {r.id for r in sampling.stable_sample(df, "id", 0.4, "s").collect()}
    assert first == again and first <= grown and {i for i in grown if i.startswith("id")} <= first | {""} and first < wider
    assert 120 < len(first) < 240 and None not in first
    counts = {r.id: r.n_rows for r in sampling.sampled_keys(df, "id", 0.2, "s").collect()}
    assert counts.keys() == first and sum(counts.values()) == sampling.stable_sample(df, "id", 0.2, "s").count()
    assert sampling.stable_sample(df, "id", 0, "s").count() == 0 and sampling.stable_sample(df, "id", 1, "s").count() == 1001
    assert sampling.sampled_keys(df.limit(0), "id", 0.5, "s").count() == 0


# --- p4 -----------------------------------------------------------------------------------------------------------------
CLEAN = ["Ο ραδιόφωνο studio mix «α» “β” – — … № 5 18° m² ½ ¾ e-mail", "", None, "μέσα· ύστερα; ναι", "browser-άκι GPS"]
DIRTY = [
    ("ραδιόφωvo", "ραδιόφωνο"), ("Ｖoice ５％", "Voice 5%"), ("όχι", "όχι"), ("α​β﻿", "αβ"), ("α β γ　δ", "α β γ δ"), ("στον κόсμο", "στον κόςμο"),
    ("µέρα", "μέρα"), ("΄Αλλο α΄λλο", "Άλλο άλλο"), ("ένα;", "ένα;"), ("browsеr", "browser"), ("οβολ­ός", "οβολός"), ("о φάρος", "ο φάρος"), ("ﾠα", "α"), ("K Ω".replace("K", "K").replace("Ω", "Ω"), "K Ω"),
]


def test_consistent_form(spark):
    texts = [*CLEAN, *[d for d, _ in DIRTY]]
    df = spark.createDataFrame([(str(i), t, t, "c0") for i, t in enumerate(texts)], "id string, a string, b string, c0 string")
    got = {int(r.id): r for r in lookalikes.consistent_form(df, ["a", "b"], ["id"]).collect()}
    for i, t in enumerate(CLEAN):
        assert (got[i].a_clean, got[i].a_changed) == (t, False)
    for i, (_, clean) in enumerate(DIRTY, len(CLEAN)):
        assert (got[i].a_clean, got[i].a_changed, got[i].b_clean) == (clean, True, clean)
    again = df.limit(0).unionByName(spark.createDataFrame([(str(i), c, c, "") for i, (_, c) in enumerate(DIRTY)], df.schema))
    assert lookalikes.changed_fields(again, ["a", "b"], ["id"]).count() == 0
    found = {(r.id, r.field) for r in lookalikes.changed_fields(df.union(df), ["a", "b"], ["id"]).collect()}
    assert len(found) == 2 * len(DIRTY) and lookalikes.changed_fields(df.limit(0), ["a", "b"], ["id"]).count() == 0


# --- p5 -----------------------------------------------------------------------------------------------------------------
def test_swap_repair_reaches_the_best():
    have = {("a",): 50, ("b",): 9, ("a", "b"): 5, (): 40}
    targets = {"a": (0.5, 2), "b": (0.4, 3)}
    take = quota.swap_repair(have, 30, targets, 1)
    assert sum(take.values()) == 30 and all(0 <= take[s] <= have[s] for s in have)

    def deviation(t):
        return sum((sum(n for s, n in t.items() if c in s) - max(-(-int(share * 100) * 30 // 100), floor)) ** 2 for c, (share, floor) in targets.items())

    keys = list(have)
    best = min(deviation(dict(zip(keys, c))) for c in itertools.product(*[range(have[k] + 1) for k in keys[:3]], [0]) if (r := 30 - sum(c[:3])) >= 0 and r <= 40)
    assert deviation(take) == best


def test_large_floors_take_few_draws():
    have = {("a",): 10**12, ("a", "b"): 10**12, ("b",): 10**9, (): 10**12}
    take = quota.swap_repair(have, 10**12, {"a": (0.5, 4 * 10**11), "b": (0.3, 10**9)}, 1)
    assert sum(take.values()) == 10**12 and take["a",] + take["a", "b"] == 5 * 10**11 and take["a", "b"] + take["b",] == 3 * 10**11


def test_quota_plan(spark):
    rows = [("t", f"a{i}", "big") for i in range(300)] + [("t", f"b{i}", "small") for i in range(5)] + [("t", f"n{i}", None) for i in range(95)] + [("t", None, "big"), ("t", "a1", "big"), ("t", "x", "other")]
    df = spark.createDataFrame(rows, "table_name string, id string, category string")
    targets = spark.createDataFrame([("t", "big", 0.5, 1, 0.1), ("t", "small", 0.2, 3, 0.1), ("t", "absent", 0.1, 1, 0.1), ("empty", "c", 0.5, 2, 0.1), (None, "big", 0.5, 1, 0.1), ("t", None, 0.5, 1, 0.1), ("t", "nulls", None, 1, 0.1), ("t", "free", 0.0, None, 0.1)], "table_name string, category string, target_share double, min_rows long, sample_share double")
    plan = quota.QuotaPlan(df, targets, "s")
    report = {(r.table_name, r.category): r for r in plan.report().collect()}
    assert not report["t", "small"].can_be_met and report["t", "small"].drawn == 5 and report["t", "big"].drawn == 20
    assert len(report) == 5 and report["t", "free"].can_be_met
    assert not report["t", "absent"].can_be_met and not report["empty", "c"].can_be_met
    assert all((r.short_by > 0 and r.drawn == r.available) for r in report.values() if not r.can_be_met) and report["t", "big"].short_by == 0
    sample = plan.sample().collect()
    assert len(sample) == len({r.id for r in sample}) == 40
    wide = spark.range(quota.MAX_SIGNATURES + 5).selectExpr("'t' table_name", "cast(id as string) id", "cast(id as string) category")
    with pytest.raises(ValueError):
        quota.QuotaPlan(wide, wide.selectExpr("table_name", "category", "0.1D target_share", "1L min_rows", "0.1D sample_share"), "s")
    assert {r.id for r in quota.QuotaPlan(df.repartition(7), targets, "s").sample().collect()} == {r.id for r in sample}
    assert quota.QuotaPlan(df.limit(0), targets, "s").sample().count() == 0


# --- p6 -----------------------------------------------------------------------------------------------------------------
def test_leaks_match_brute_force(spark):
    rng = random.Random(5)
    vocabulary = [f"λέξη{i}" for i in range(60)]
    items = [(i, " ".join(rng.choices(vocabulary, k=rng.randint(9, 26)))) for i in range(12)] + [(90, None), (91, ""), (92, "μικρό κείμενο εδώ")]
    docs = []
    for d in range(120):
        words = rng.choices(vocabulary, k=rng.randint(0, 60))
        i = rng.randrange(12)
        ws = items[i][1].split()
        if d % 3 == 0:
            k = rng.randint(5, 10)
            at = rng.randrange(max(1, len(ws) - k))
            words[3:3] = ws[at : at + k]
        elif d % 3 == 1:
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(ws))
                ws[at : at + 1] = rng.choice([[], ["άλλο"], [ws[at], "κι"]])
            words[2:2] = ws
        docs.append((d, " ".join(words).upper() if d % 2 else " , ".join(words), "x"))
    docs += [(500, None, "x"), (501, "", "x"), (502, "ΜΙΚΡΟ​ κείμενο  εδω!", "x"), docs[0]]
    d = spark.createDataFrame(docs, "doc_id long, text string, item_id string")
    i = spark.createDataFrame(items + items[:2], "item_id long, text string")
    want = set()
    for doc, text, _ in docs:
        ws = leakage.plain_words(text or "")
        for item, it in items:
            own = leakage.plain_words(it or "")
            if own and ws and (leakage.longest_run(own, ws) >= min(8, len(own)) or (len(own) >= 4 and leakage.edits_inside(own, ws) <= 2)):
                want.add((doc, item))
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, i).collect()} == want and len(want) > 50
    assert {(r.doc_id, r.item_id) for r in leakage.leaks(d, i, group_chars=900).collect()} == want
    assert leakage.leaks(d.limit(0), i).count() == 0 and leakage.leaks(d, i.limit(0)).count() == 0


def test_multi_index_finds_all_within_the_radius():
    rng = np.random.default_rng(1)
    prints = rng.integers(0, 1 << 63, 400).astype(np.uint64)
    probes = prints[:200] ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64)) ^ (np.uint64(1) << rng.integers(0, 64, 200).astype(np.uint64))
    index = leakage.MultiIndex(prints, np.arange(400))
    at, items = index.within(probes)
    got = set(zip(at.tolist(), items.tolist()))
    want = {(a, b) for a in range(200) for b in range(400) if bin(int(probes[a]) ^ int(prints[b])).count("1") <= leakage.RADIUS}
    assert got == want and {(k, k) for k in range(200)} <= got


def test_very_long_document(spark):
    item = " ".join(f"λ{i}" for i in range(20))
    text = "α β γ " * 30_000 + item + " δ ε" * 1000
    d = spark.createDataFrame([(1, text)], "doc_id long, text string")
    assert leakage.leaks(d, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 1


# --- p7 -----------------------------------------------------------------------------------------------------------------
def test_splitting_tree_is_exact():
    quotas = np.array([100, 7, 0, 33])
    source = np.repeat(np.arange(4), quotas)
    rank = np.concatenate([np.arange(q) for q in quotas])
    tree = mixture.SplittingTree(quotas, 8, 3)
    shard = tree.shard_of(source, rank)
    assert set(np.bincount(shard, minlength=8)) <= {17, 18}
    order = np.random.default_rng(1).permutation(len(rank))
    assert (tree.shard_of(source[order], rank[order]) == shard[order]).all() and (tree.shard_of(source[:1], rank[:1]) == shard[:1]).all()
    counts = np.bincount(mixture.SplittingTree(np.array([6, 2]), 4, 5).shard_of(np.repeat([0, 1], [6, 2]), np.array([*range(6), 0, 1])), minlength=4)
    assert counts.tolist() == [2, 2, 2, 2] and len(mixture.SplittingTree(np.zeros(2, np.int64), 8, 1).shard_of(np.array([], np.int64), np.array([], np.int64))) == 0


def test_mixture(spark):
    rng = random.Random(4)
    text = lambda: " ".join(rng.choices(["ένα", "δύο", "τρία", "house"], k=rng.randint(20, 60)))
    docs = [(i, text(), s) for i, s in enumerate(rng.choices(["Big", "big ", "mid-dle", "tiny", "other", None], [60, 20, 30, 5, 10, 5], k=900))]
    docs += [(9000, docs[0][1], "big"), (9001, None, "big"), (None, "x", "big"), docs[3]]
    d = spark.createDataFrame([(*r, "k") for r in docs], "doc_id long, text string, source string, k string").repartition(6)
    targets = spark.createDataFrame([("big", 0.6, 1), ("mid_dle", 0.3, 2), ("tiny", 0.05, 5), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    m = mixture.Mixture(d, targets)
    rows = m.rows().collect()
    shares = {r.source: r for r in m.shares().collect()}
    total = sum(r.n_tokens for r in rows)
    texts = {i: t for i, t, _ in docs if i is not None}
    repeats = collections.Counter(texts[r.doc_id] for r in rows)
    for s, most in (("big", 1), ("mid_dle", 2), ("tiny", 5)):
        own = [r for r in rows if r.source == s]
        assert abs(sum(r.n_tokens for r in own) / total - shares[s].actual_share) < 1e-9 and abs(shares[s].actual_share - shares[s].target_share / 0.95) < 0.02
        assert max(repeats[texts[r.doc_id]] for r in own) <= most
    assert shares["absent"].actual_share == 0 and not shares["absent"].reached
    again = mixture.Mixture(d.repartition(3), targets).rows().collect()
    assert {(r.shard, r.doc_id, r.repeat) for r in again} == {(r.shard, r.doc_id, r.repeat) for r in rows}
    assert mixture.Mixture(d.limit(0), targets).rows().count() == 0 and mixture.Mixture(d, targets.limit(0)).rows().count() == 0
    assert all(r.text == texts[r.doc_id] for r in rows) and len({(r.doc_id, r.repeat) for r in rows}) == len(rows)
    small = mixture.Mixture(d, targets, shard_tokens=10)
    cut = small.rows().collect()
    assert small.shards > 500 and small.fine > 1 and len({r.shard for r in cut}) > 300 and {(r.doc_id, r.repeat) for r in cut} == {(r.doc_id, r.repeat) for r in rows}
    pressed = spark.createDataFrame([("big", 0.7, 1), ("tiny", 0.3, 1)], targets.schema)
    held = [sum(r.tokens for r in mixture.Mixture(d, pressed, keep=k).shares().collect()) for k in (0.0, 0.9)]
    assert 2 * held[0] < held[1]
    with pytest.raises(ValueError):
        mixture.Mixture(d, spark.range(3000).selectExpr("cast(id as string) source", "0.1D target_share", "1 max_repeats"))
    full = mixture.Mixture(d, targets, budget=10**9)
    assert all(r.repeats_used == r.max_repeats for r in full.shares().collect() if r.source != "absent")


# --- p8 -----------------------------------------------------------------------------------------------------------------
def test_codewords_and_labels(spark):
    code = languages.codewords()
    assert min((code[i] != code[j]).sum() for i in range(len(code)) for j in range(i)) >= 7
    labels = ["el", "EL", "ell", "Greek", "el-GR", "en_US", "deu", " fr ", "español", "tr", "", " ", "??", None, "mul"]
    got = [r.n for r in spark.createDataFrame([(v,) for v in labels], "v string").select(languages.named_language(F.col("v")).alias("n")).collect()]
    assert got == ["el"] * 5 + ["en", "de", "fr", "es"] + [None] * 6


SENTENCES = {
    "en": ["The village choir reviewed the old timetable before the visitors arrived.", "Nobody had expected that the archive would be open this morning.", "She left the notes on the shelf because the hallway was too loud."],
    "de": ["Der Dorfchor prüfte den alten Fahrplan, bevor die Gäste kamen.", "Niemand hatte damit gerechnet, dass das Archiv heute geöffnet wäre.", "Sie legte die Hinweise ins Regal, weil der Gang zu laut war."],
    "fr": ["La chorale du village relut le vieil horaire avant l'arrivée des visiteurs.", "Personne ne s'attendait à ce que les archives soient ouvertes ce matin.", "Elle laissa les remarques sur l'étagère, car le couloir était trop bruyant."],
    "es": ["El coro del pueblo revisó el viejo horario antes de que llegaran las visitas.", "Nadie esperaba que el archivo estuviera abierto esta mañana.", "Ella dejó las notas en el estante porque el pasillo era demasiado ruidoso."],
    "it": ["Il coro del paese rilesse il vecchio orario prima che arrivassero gli ospiti.", "Nessuno si aspettava che l'archivio fosse aperto questa mattina.", "Lei lasciò gli appunti sullo scaffale perché il corridoio era troppo rumoroso."],
    "el": ["Η χορωδία του χωριού διάβασε το παλιό δρομολόγιο πριν φτάσουν οι επισκέπτες.", "Κανείς δεν περίμενε ότι το αρχείο θα ήταν ανοιχτό σήμερα το πρωί.", "Άφησε τις σημειώσεις στο ράφι, επειδή ο διάδρομος είχε πολύ θόρυβο."],
}


def test_small_documents(spark):
    train = [(i * 10 + k, " ".join(ss), lang) for i, (lang, ss) in enumerate(SENTENCES.items()) for k in range(3)]
    schema = "doc_id long, text string, lang string"
    model = languages.training_model(spark.createDataFrame(train, schema))
    mixed = SENTENCES["el"][0] + " " + SENTENCES["fr"][0] + "\n• " + SENTENCES["el"][1]
    docs = [
        (1, SENTENCES["en"][0], "en-GB"), (2, SENTENCES["de"][0], "en"), (3, mixed, "el"), (4, SENTENCES["it"][1], None), (5, None, "el"), (6, "", "el"), (7, "12 …", None),
        (8, languages.romanised(SENTENCES["el"][1], 0), "el"), (9, "Το βιβλίο με τίτλο «The Quiet Harbour Notes» είναι εδώ.", "el"), (10, SENTENCES["es"][2] * 2000, "es"),
    ]
    d = spark.createDataFrame(docs, schema)
    got = {(r.doc_id, r.true_lang) for r in languages.mislabelled(d.union(d), model).collect()}
    assert got == {(2, "de"), (3, "el"), (3, "fr"), (4, "it")}
    segments = [(r.lang, mixed[r.start : r.end]) for r in languages.language_segments(d, model).filter("doc_id = 3").orderBy("segment").collect()]
    assert [s[0] for s in segments] == ["el", "fr", "el"] and segments[1][1].startswith("La chorale")
    langs = {r.doc_id: r for r in languages.document_languages(d, model).collect()}
    assert langs[8].lang == "el" and langs[3].n_languages == 2 and 0 < langs[1].confidence <= 1 and 7 not in langs
    empty = d.limit(0)
    assert languages.mislabelled(empty).count() == 0 and languages.document_languages(empty).count() == 0


def test_short_sentences_count(spark):
    train = [(i * 10 + k, " ".join(ss), lang) for i, (lang, ss) in enumerate(SENTENCES.items()) for k in range(3)]
    schema = "doc_id long, text string, lang string"
    model = languages.training_model(spark.createDataFrame(train, schema))
    docs = [(1, "Κανείς δεν περίμενε.", None), (2, SENTENCES["el"][0] + " Nobody had expected.", "el"), (3, "το παλιό δρομολόγιο", " "), (4, "Κανείς δεν περίμενε.", "el"), (5, SENTENCES["el"][0] + " nobody had expected", "el")]
    got = {(r.doc_id, r.true_lang) for r in languages.mislabelled(spark.createDataFrame(docs, schema), model).collect()}
    assert got == {(1, "el"), (2, "el"), (2, "en"), (3, "el")}


@pytest.mark.skipif(not Path("/root/testdata/sf0.01").exists(), reason="needs the test tables")
def test_held_out_accuracy(spark):
    """Fitted on the documents of one half, read on those of the other and on sentences from outside."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text", "lang")
    half = sampling.unit_interval(F.col("doc_id"), "held-out") < 0.5
    model = languages.training_model(docs.filter(half))
    outside = spark.createDataFrame([(n, s, lang) for n, (lang, s) in enumerate((lang, s) for lang, ss in SENTENCES.items() for s in ss)], "doc_id long, text string, lang string")
    assert all(r.lang == r.want for r in languages.document_languages(outside, model).join(outside.select("doc_id", F.col("lang").alias("want")), "doc_id").collect())
    foreign = ["Köy korosu misafirler gelmeden önce eski tarifeyi gözden geçirdi.", "Chór wiejski przejrzał stary rozkład jazdy, zanim przyjechali goście.", "Деревенский хор просмотрел старое расписание до приезда гостей."]
    flagged = languages.language_segments(outside.union(spark.createDataFrame([(100 + n, s, None) for n, s in enumerate(foreign)], outside.schema)), model)
    found = {r.doc_id for r in flagged.filter("ambiguous").collect()}
    assert {100, 101, 102} <= found and len(found) <= 4  # a fit on so few documents may flag a known language too
    other = docs.filter(~half)
    # One language by both its label and its script: Greek against Latin letters tells noisy labels of Greek from right ones.
    greek = F.length(F.regexp_replace("text", "[^\u0370-\u03ff\u1f00-\u1fff]", "")) > 0.9 * F.length(F.regexp_replace("text", "\\P{L}", ""))
    named = other.withColumn("want", languages.named_language(F.col("lang"))).withColumn("greek", greek)
    both = languages.document_languages(other, model).join(named.select("doc_id", "want", "greek"), "doc_id")
    assert both.filter("greek and lang <> 'el'").count() == 0 and both.filter("greek").count() > 100
    latin = both.filter("not greek and want <> 'el' and n_languages = 1").agg(F.count("*").alias("n"), F.count_if(F.col("want") == F.col("lang")).alias("right")).first()
    assert latin.n > 50 and latin.right / latin.n > 0.9
