"""The text operators against brute force on small fixtures, and their defined results for odd rows."""

import random
import re
from itertools import combinations

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from corpusloom.llm import boilerplate, keyword_pages, mixing, near_duplicates, packing, pii, repeated_lines, residue, residue_train, splitting, text_quality
from corpusloom.llm.tokenizing import encoding, vocabulary_path

WORDS = "the order plan panel of and kettle is stored garden when frost it lamp report small team in quiet".split()


def prose(rnd, n):
    return " ".join(f"The {rnd.choice(WORDS)} {rnd.choice(WORDS)} of the {rnd.choice(WORDS)} is stored in the {rnd.choice(WORDS)} {rnd.randint(1, 99)} times." for _ in range(n))


# ---- splitting


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!\n　é", max_size=900), st.integers(20, 120), st.integers(0, 19))
def test_pieces_cover_the_text(text, limit, overlap):
    found = splitting.pieces(text, limit, overlap)
    assert "".join(text[core:end] for _, core, end in found) == text
    assert all(end - start <= limit and core - start <= overlap for start, core, end in found)
    assert all(a[2] == b[1] for a, b in zip(found, found[1:]))


def test_pieces_end_at_natural_places_and_share_text():
    text = prose(random.Random(1), 80)
    found = splitting.pieces(text)
    assert len(found) > 3
    assert all(text[end - 1] == " " for _, _, end in found[:-1])
    assert all(150 < core - start <= 200 for start, core, _ in found[1:])
    with pytest.raises(ValueError):
        splitting.cores("x" * 50, 10, 10)


def test_split_oversized_rows(spark):
    long = prose(random.Random(2), 100)
    rows = [("page", 1, long, "x"), ("page", 2, None, "x"), ("page", 3, "", "x"), ("page", 4, "short", "x"), ("page", 5, "z" * 6000, None)]
    df = spark.createDataFrame(rows, "item_kind string, item_id bigint, body string, piece string")
    out = splitting.split_oversized(df, "body", 5000).collect()
    assert {r["item_id"] for r in out} == {1, 5}
    mine = sorted((r for r in out if r["item_id"] == 1), key=lambda r: r["piece_no"])
    assert "".join(r["piece"][r["core_start"] - r["start"] :] for r in mine) == long
    assert splitting.split_oversized(df.limit(0), "body", 5000).count() == 0


# ---- near duplicates


def jaccard(a, b, n):
    s, t = (set(zip(*(x[i:] for i in range(n)))) if len(x) >= n else {tuple(x)} for x in (near_duplicates.tokens(a), near_duplicates.tokens(b)))
    return len(s & t) / len(s | t)


def test_near_duplicates_against_brute_force(spark):
    rnd = random.Random(3)
    texts = {}
    for i in range(60):
        base = prose(rnd, 12).split()
        texts[len(texts)] = " ".join(base)
        for _ in range(rnd.randint(0, 3)):
            edited = list(base)
            for _ in range(rnd.randint(0, 12)):
                edited[rnd.randrange(len(edited))] = rnd.choice(WORDS)
            texts[len(texts)] = " ".join(edited)
    rows = [(i, t, "x") for i, t in texts.items()] + [(900, None, "x"), (901, "", "x"), (902, "few words", "x")]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, id string")
    for n, least, floor in ((3, 0.7, 50), (5, 0.8, 1)):
        want = {(a, b) for a, b in combinations(texts, 2) if jaccard(texts[a], texts[b], n) >= least}
        got = {tuple(r) for r in near_duplicates.similar_pairs(df, shingle=n, similarity=least, min_tokens=floor).collect()}
        assert want and got == want
    groups = {r["id"]: r for r in near_duplicates.groups(df, shingle=3, similarity=0.7, min_tokens=50).collect()}
    assert set(groups) == set(texts) | {900, 901, 902}
    assert groups[900]["group_id"] == 900 and groups[900]["links"] == 0
    parent = {i: i for i in texts}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in combinations(texts, 2):
        if jaccard(texts[a], texts[b], 3) >= 0.7:
            a, b = sorted((find(a), find(b)))
            parent[b] = a
    assert all(groups[i]["group_id"] == find(i) for i in texts)
    assert near_duplicates.similar_pairs(df.limit(0)).count() == 0


def test_short_sketches_share_a_key(spark):
    """Shared values that lie in twos, so that no three of them are neighbours: 12 of 17 and 14 of 20."""
    rows = []
    for pattern in ("11011011011011011", "11011011011011011011"):
        values = np.array(sorted(random.Random(16).sample(range(1 << 40), len(pattern))), np.uint64)
        for part in (values, values[[c == "1" for c in pattern]]):
            rows.append((len(rows), len(part), bytearray(part.tobytes())))
    keys: dict = {}
    for r in near_duplicates._postings(spark.createDataFrame(rows, "id bigint, n_shingles int, sketch binary"), near_duplicates.SKETCH).collect():
        keys.setdefault(r["id"], set()).add(r["key"])
    assert keys[0] & keys[1] and keys[2] & keys[3]


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(1, 40)] + [(100, 101)], "a bigint, b bigint")
    got = {r["class_id"]: r["group_id"] for r in near_duplicates.components(links).collect()}
    assert all(got[i] == 1 for i in range(2, 41)) and got[101] == 100


# ---- lines repeated within a host


def test_repeated_lines(spark):
    rows = [(i, f"https://WWW.A.example:443/p{i}", f"Legal notice {i}!\nown {'abcdefghij'[i]}\n\n12 34\nLEGAL, notice", 1) for i in range(10)]
    rows += [(20, None, "Legal notice", 1), (21, "https://b.example/", None, 1), (22, "https://b.example/x", "", 1), (23, "https://b.example/y", "Legal notice", 1)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, text string, host int")
    got = {tuple(r) for r in repeated_lines.repeated_lines(df).collect()}
    assert got == {(i, n) for i in range(10) for n in (0, 4)}
    kept = {r["page_id"]: (r["kept_text"], r["removed"]) for r in repeated_lines.without_repeated_lines(df).collect()}
    assert kept[3] == ("own d\n\n12 34", 2) and kept[20] == ("Legal notice", 0) and kept[21] == (None, 0) and len(kept) == len(rows)
    patterns = repeated_lines.frequent_sequences(df).collect()
    assert sorted(r["length"] for r in patterns) == [1, 2]
    assert repeated_lines.repeated_lines(df.limit(0)).count() == 0


def brute_closed(rows, least):
    """Frequent patterns of two or more that no longer pattern holds with the same support."""
    support: dict = {}
    for items, n in rows:
        for p in {tuple(items[i] for i in at) for k in range(1, len(items) + 1) for at in combinations(range(len(items)), k)}:
            support[p] = support.get(p, 0) + n

    def holds(long, short):
        rest = iter(long)
        return all(x in rest for x in short)

    often = {p: n for p, n in support.items() if n >= least}
    return {p: n for p, n in often.items() if len(p) > 1 and not any(m == n and len(q) > len(p) and holds(q, p) for q, m in often.items())}


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.lists(st.sampled_from("abcd"), max_size=6).map(tuple), st.integers(1, 3)), max_size=7), st.integers(1, 5))
def test_closed_patterns_against_brute_force(rows, least):
    firsts = {x for items, _ in rows for x in items}
    got = [f for x in firsts for f in repeated_lines.closed_patterns([r for r in rows if x in r[0]], x, least)]
    assert dict(got) == brute_closed(rows, least) and len(dict(got)) == len(got)


def test_patterns_skip_lines_and_have_no_greatest_length(spark):
    frame = "\n".join(["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"])
    rows = [(i, f"https://a.example/{i}", "alpha\ngamma" if i < 4 else "alpha\nbeta\ngamma") for i in range(10)]
    rows += [(20 + i, f"https://b.example/{i}", frame) for i in range(6)]
    got = repeated_lines.frequent_sequences(spark.createDataFrame(rows, "page_id bigint, url string, text string")).collect()
    assert sorted((r["length"], r["pages"]) for r in got if r["host"] == "a.example") == [(1, 6), (1, 10), (1, 10), (2, 10), (3, 6)]
    assert sorted((r["length"], r["pages"]) for r in got if r["host"] == "b.example") == [(1, 6)] * 7 + [(7, 6)]


def test_level_one_covers_the_lines_of_all_patterns(spark):
    rnd = random.Random(13)
    frame = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta", "eta"]
    rows = [(i, f"https://h{i % 2}.example/{i}", "\n".join(x for x in [*frame, "own " + "abcdefghij"[i % 10] * (i + 1)] if rnd.random() < 0.5)) for i in range(40)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, text string")
    keys = {(r["page_id"], n): (r["host"], key) for r in repeated_lines.line_sequences(df).collect() for n, key in enumerate(r["keys"])}
    in_patterns = {(r["host"], key) for r in repeated_lines.frequent_sequences(df).collect() if r["length"] > 1 for key in r["pattern"]}
    got = {tuple(r) for r in repeated_lines.repeated_lines(df).collect()}
    assert in_patterns and {at for at, line in keys.items() if line in in_patterns} <= got
    singles = {(r["host"], r["pattern"][0]) for r in repeated_lines.frequent_sequences(df).collect() if r["length"] == 1}
    assert got == {at for at, line in keys.items() if line in singles | in_patterns}


def test_long_lists_are_paired_in_blocks(spark, monkeypatch):
    monkeypatch.setattr(near_duplicates, "LIST", 4)
    rnd = random.Random(12)
    lists = {key: [i for i in range(60) if rnd.random() < share] for key, share in ((1, 0.9), (2, 0.05), (3, 0.3), (4, 0.0))}
    rows = spark.createDataFrame([(key, i, i % 7) for key, ids in lists.items() for i in ids], "key bigint, id bigint, n int")
    want = sorted({(a, b) for ids in lists.values() for a, b in combinations(ids, 2)})
    assert sorted(map(tuple, near_duplicates._pairs(rows).collect())) == want
    assert sorted(map(tuple, near_duplicates._pairs(rows, 0.5).collect())) == [(a, b) for a, b in want if min(a % 7, b % 7) >= 0.5 * max(a % 7, b % 7)]
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    try:
        assert sorted(map(tuple, near_duplicates._pairs(rows).collect())) == want
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert near_duplicates._pairs(rows.limit(0)).count() == 0
    same = spark.createDataFrame([(i, "one two three four five six") for i in range(30)], "doc_id bigint, text string")
    assert near_duplicates.similar_pairs(same).count() == 30 * 29 // 2


# ---- keyword pages


def test_keyword_pages(spark):
    rnd = random.Random(4)
    keys = " | ".join(f"{rnd.choice(WORDS)} lamp {rnd.randint(1, 400)}" for _ in range(60))
    links = "\n".join(f"https://a.example/{i}\nquiet lamp {rnd.choice(WORDS)}" for i in range(40))
    repeated = "\n".join("Looking for quiet lamp? Our quiet lamp is the best quiet lamp for a garden lamp and quiet lamp, buy quiet lamp now." for _ in range(6))
    glossary = "\n".join(f"Lamp {i}: {prose(rnd, 1)}" for i in range(10))
    tagged = prose(rnd, 20) + "\nTags: lamp, garden, kettle, panel, report"
    rows = [(1, keys), (2, links), (3, repeated), (4, glossary), (5, tagged), (6, None), (7, ""), (8, prose(rnd, 3)), (1, keys)]
    df = spark.createDataFrame([(i, t, None, "x") for i, t in rows], "page_id bigint, text string, links array<string>, id string")
    assert sorted(r["page_id"] for r in keyword_pages.keyword_pages(df).collect()) == [1, 1, 2, 3]
    assert keyword_pages.keyword_pages(df.limit(0)).count() == 0


def test_keyword_pages_of_few_words():
    links = "\n".join(f"https://a.example/{i}" for i in range(30))
    keys = "lamp | garden lamp | kettle | panel | quiet lamp | frost | report | lamp 12 | team | order"
    repeated = "quiet lamp cheap quiet lamp best quiet lamp garden lamp quiet lamp buy quiet lamp"
    many = [f"https://a.example/{i}" for i in range(500)]
    assert keyword_pages.is_keyword_page("Link list here", many)
    assert not any(keyword_pages.is_keyword_page(t, own) for t, own in (("404 Not found", many[:20]), (None, many), ("", many), ("Link list here", many[:1] * 500), ("Link list here", [None])))
    calm = ["#{subtitle}\nBy ${author.name}\nPrice: {{company}} %PAGE_TITLE%\n%%SLOGAN%%.\nName: <%= product_name %>", "Home | Blog | Contact\nThe lamp guide", "The lamp is stored in the garden.", "404 Not found"]
    assert all(map(keyword_pages.is_keyword_page, (links, keys, repeated)))
    assert not any(map(keyword_pages.is_keyword_page, calm))


# ---- template residue


@pytest.fixture(scope="module")
def weights():
    return residue.weights()


def test_residue_spots_and_quotes(weights):
    rnd = random.Random(6)
    good = prose(rnd, 15)
    cases = [
        (None, "404 Not found\nThis link has expired."), ("Not found - Acme", good), (None, good + " We keep the {{ name }} of every order."), (None, "Please enable JavaScript to continue."),
        ("Home", "Lorem ipsum dolor sit amet magna aliqua."), (None, good + "\nPrice: undefined"), (None, "Bitte versuchen Sie es später erneut.\nInterner Fehler"),
    ]
    calm = [(None, good), ("What a 404 page should say", good), (None, good + " A template may hold a mark such as `{{ name }}`, and the editor fills it."), (None, None), (None, ""), ("", good)]
    assert all(residue.is_residue(weights, t, x) for t, x in cases)
    assert not any(residue.is_residue(weights, t, x) for t, x in calm)
    for title, text in cases + calm:
        assert len(residue.scores(weights, title, text)) == len(residue.spots(title, text))


def test_residue_of_unseen_wording_and_calm_pages(weights):
    calm = "The village lies on a low hill above the river. Its oldest house dates from 1640. Every spring the orchards bloom."
    cases = ["Error establishing a database connection", "An error occurred while loading this page.", "Sorry, this page could not be displayed.", "Hello {{user}}", "Please switch on JavaScript to see this site.", "The page cannot be found", "Your text here", "This site is undergoing maintenance", "Call to undefined function in /var/www/x.php on line 9"]
    plain = ["Visitors reach the tower by 404 steps.", "JavaScript is a language of the web. We teach it on Mondays.", "The museum was under construction for ten years.", "The server of the inn is friendly.", "The bus 502 leaves at nine."]
    assert all(residue.is_residue(weights, None, x) and residue.is_residue(weights, "A village", f"{calm}\n{x}\n{calm}") for x in cases)
    assert not any(residue.is_residue(weights, None, x) or residue.is_residue(weights, "A village", f"{calm}\n{x}\n{calm}") for x in plain)
    assert not any(residue.is_residue(weights, t, calm) for t in ("A village", "Weekly plans", "Our gardens in spring"))


def test_residue_pages_and_unseen_hosts(spark):
    rnd = random.Random(7)
    rows = []
    for i in range(300):
        bad = i % 10 == 0
        text = rnd.choice(["403 Forbidden\nYou do not have permission to view this resource.", "Your text goes here.\nHeadline goes here"]) if bad else prose(rnd, 8)
        rows.append((i, f"https://h{i % 29}.example/{i}", None if i % 3 else "Home", text, "x"))
    rows += [(900, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id bigint, url string, title string, text string, score string")
    fitted = residue_train.fit(df)
    got = {r["page_id"] for r in residue.residue_pages(df, fitted).collect()}
    assert got == set(range(0, 300, 10))
    measured = residue_train.validate(df)
    assert measured["cases"] > 0 and measured["precision"] == measured["recall"] == 1
    assert residue.residue_pages(df.limit(0)).count() == 0


def test_short_bodies_of_failed_requests_are_labels(spark):
    rows = [(404, "<html><title>Gone</title><p>No such page here</p></html>"), (503, None), (200, "<p>fine</p>"), (404, "<p>" + "word " * 50 + "</p>"), (500, "")]
    assert residue_train.status_rows(spark.createDataFrame(rows, "status int, body string")) == ["Gone No such page here"]


# ---- frame lines


SYLLABLES = "ba zu ke lor min tav qui dro fex hul jor pim wen cas tol".split()


def unseen_site(seed: int, pages: int, host: str = "www.unseen.example"):
    """Pages of a site whose frame is made of invented words, ``(id, url, title, text, links)``, and the frame lines of each."""
    rnd = random.Random(seed)
    word = lambda: "".join(rnd.choice(SYLLABLES) for _ in range(rnd.randint(1, 3)))
    phrase = lambda n: " ".join(word() for _ in range(n)).capitalize()
    menu = [" ".join(word().capitalize() for _ in range(6)), phrase(3), " | ".join(word().capitalize() for _ in range(4))]
    related, foot = phrase(2), [phrase(9) + ".", "© 2024 Unseen " + phrase(3), " · ".join(phrase(2) for _ in range(4))]
    titles = [f"{phrase(4)}" for _ in range(pages)]
    rows, frames = [], set()
    for i in range(pages):
        own = [titles[i], *(f"{prose(rnd, 4)} {phrase(9)}." for _ in range(4))]
        others = rnd.sample(titles, 3)
        lines = [*menu, *own, related, *others, *foot]
        rows.append((i, f"https://{host}/{i}/{'-'.join(titles[i].lower().split())}-{i}", titles[i], "\n".join(lines), [f"https://{host}/x/{'-'.join(t.lower().split())}-1" for t in others]))
        frames |= {(i, n) for n in range(len(lines)) if not len(menu) <= n < len(menu) + len(own)}
    return rows, frames


PAGE_TYPE = "page_id bigint, url string, title string, text string, links array<string>"


def test_frame_lines_of_a_site_whose_words_are_in_no_table(spark):
    rows, frames = unseen_site(3, 40)
    found = {tuple(r) for r in boilerplate.frame_lines(spark.createDataFrame(rows, PAGE_TYPE)).collect()}
    assert len(found & frames) > 0.95 * len(frames) and len(found & frames) > 0.95 * len(found)


def test_frame_lines_of_odd_rows(spark):
    rows, _ = unseen_site(4, 60)
    text = rows[0][3]
    odd = [(100, None, None, text, ["https://a.example/x", None]), (101, None, None, None, None), (102, "u", "t", "", []), (103, "https://b.example/", " ", "\n \n", None), rows[0]]
    df = spark.createDataFrame([(*r, "x") for r in rows + odd], PAGE_TYPE + ", line_no string")
    found = [tuple(r) for r in boilerplate.frame_lines(df).collect()]
    assert {i for i, _ in found} <= {*range(60), 100}
    zero = [n for i, n in found if i == 0]
    assert sorted(zero) == sorted([*set(zero)] * 2)  # both rows of page 0 are judged alike
    assert boilerplate.frame_lines(df.limit(0)).count() == 0
    one = df.where("page_id != 0")
    main = {r["page_id"]: r["main_text"] for r in boilerplate.main_text(one).collect()}
    own = "\n".join(rows[5][3].split("\n")[3:8])
    assert main[5] == own and main[101] is None and main[102] == "" and main[103] == ""


def test_parts_of_lines_and_slugs():
    urls, titles = ["https://www.Acme.example:80/blog/the-lamp-guide-of-acme-12"], ["The lamp guide - Acme"]
    text = "Home | Blog: Acme\n\nThe lamp guide of Acme\n10 lamps for acme. From grid to lamp\nthe lamp GUIDE\n"
    keys, parts, lines = boilerplate.described(urls, titles, [residue.page_tokens(titles[0], text)], [["https://x.example/home-blog-acme"]])[0]
    assert parts["line"].tolist() == [0, 0, 0, 2, 3, 3, 4] and parts["words"].tolist() == [1, 1, 1, 5, 4, 4, 3]
    flag = lambda bit: [n for n, x in enumerate(lines["flags"]) if x & bit]
    assert flag(boilerplate._FULL) == [0, 2, 3, 4] and flag(boilerplate._OWN) == [2, 4] and flag(boilerplate._LINKED) == [0] and len(lines) == 6
    again = boilerplate.described(urls, [None], [residue.page_tokens(None, "BLOG\n12 Lamps for Acme!")], [None])[0][0]
    assert again[0] == keys[1] and again[1] == keys[4]


def test_density_counts_parts_that_recur():
    text = "Menu one | Menu two\nA calm line"
    keys, parts, lines = boilerplate.described([None], [None], [residue.page_tokens(None, text)], [None])[0]
    x, numbers = boilerplate.features(keys, parts, lines, {int(keys[0]): (0.5, 1.0, 3, True)})
    assert numbers.tolist() == [0, 1] and x[0, boilerplate.FEATURES.index("density")] == 0.5 and x[1, boilerplate.FEATURES.index("density_before")] == 0.5


def test_tree_on_rows_it_was_not_grown_on():
    with np.load(boilerplate.Path(boilerplate.__file__).with_name("frame_lines.npz")) as table:
        x, y = table["x"].astype(np.float32), table["y"]
    assert len(y) <= boilerplate.LABELLED
    half = np.arange(len(y)) % 2 == 0
    got = boilerplate.Tree().grow(x[half], y[half]).predict(x[~half]) > 0.5
    assert (got == y[~half]).mean() > 0.97


# ---- personal information


def test_personal_items(spark):
    rnd = random.Random(9)
    text = (
        f"By Leila Hestane\n{prose(rnd, 3)} For repairs, write to Bruno Krevman at bruno.krevman@docs.acme.example or call +44 7700 900123 on weekdays. {prose(rnd, 30)}\n"
        "Parcels for Greta T. Wessow go to Flat 4, 66 Osterfield Terrace, Mirefield, QJ21 4BN, never to the depot.\nHolder: Tomas Sallero, tax ID 76/419/52665. Order 82-23-10 was stored in May."
    )
    want = {
        ("name", "Leila Hestane"), ("name", "Bruno Krevman"), ("email", "bruno.krevman@docs.acme.example"), ("phone", "+44 7700 900123"), ("name", "Greta T. Wessow"),
        ("address", "Flat 4, 66 Osterfield Terrace, Mirefield, QJ21 4BN"), ("name", "Tomas Sallero"), ("id_number", "76/419/52665"),
    }
    rows = [("page", 1, text, "x"), ("page", 1, text, "x"), ("chunk", 2, None, "x"), ("chunk", 3, "", "x"), ("chunk", 4, prose(rnd, 5), "x")]
    df = spark.createDataFrame(rows, "item_kind string, item_id bigint, body string, pii_type string")
    got = pii.personal_items(df).distinct().collect()
    assert {(r["pii_type"], r["pii_value"]) for r in got} == want and {r["item_id"] for r in got} == {1}
    masked = {r["item_id"]: r["masked"] for r in pii.masked_items(df).collect()}
    assert masked[2] is None and masked[3] == ""
    expected = text
    for kind, value in want:
        expected = expected.replace(value, pii.PLACEHOLDER[kind])
    assert masked[1] == expected
    assert pii.personal_items(df.limit(0)).count() == 0


def test_mail_addresses_end_with_their_host():
    texts = ["Mail ann.lee@acme.example. Neither the lamp nor the order is here.", "Write to Ann Velmow at avelmow [at] acme [dot] test. In May we close.", "Send the form to a-v @ acme.example. Today"]
    found = [[t[a:b] for a, b, k in f if k == "email"] for t, f in zip(texts, pii.find(texts))]
    assert found == [["ann.lee@acme.example"], ["avelmow [at] acme [dot] test"], ["a-v @ acme.example"]]


def test_windows_of_a_long_segment_agree():
    line = "Contact Leila Hestane at leila.h@acme.example or " * 12
    found = pii.find([line])[0]
    assert [line[a:b] for a, b, k in found if k == "email"] == ["leila.h@acme.example"] * 12


def test_tagger_reads_every_character(monkeypatch):
    read = []
    tag = pii.tag
    monkeypatch.setattr(pii, "tag", lambda pieces, net=None: read.extend(pieces) or tag(pieces, net))
    text = "nothing here\n\nA letter from John Smith came.\nBy April Jones\n" + "small words " * 60 + "\nlast"
    pii.find([text, text, None, ""])
    assert read == [x for x in dict.fromkeys(text.split("\n")) if x]


def test_names_and_phones_the_prefilter_left_out():
    text = "Post aus Greta Wessow kam.\nThe visitor gave their name as Łukasz Kowalski and left.\nOur trainer J. Smith can be reached at 01 42 68 53 00.\nCall +49 30 12 34 56 78 on weekdays.\nTel. 01 42 68 53 00"
    got = {(k, text[a:b]) for a, b, k in pii.find([text])[0]}
    assert got >= {("name", "Greta Wessow"), ("name", "Łukasz Kowalski"), ("name", "J. Smith"), ("phone", "+49 30 12 34 56 78"), ("phone", "01 42 68 53 00")}
    assert all(pii.checked(x, 0, len(x), "name") == (0, len(x)) for x in ("María de la Torre", "Jeanne d'Arc", "J. R. Smith", "Иван Петров", "April Jones", "Smith, J", "Greta T. Wessow"))
    assert not any(pii.checked(x, 0, len(x), "name") for x in ("the lamp", "Lamp", "A B C"))


def test_tagger_on_held_out_spans():
    from corpusloom.llm import pii_train

    with np.load(pii.Path(pii.__file__).with_name("pii_weights.npz")) as arrays:
        measured = pii_train.held_out(dict(arrays), [], batches=4)
    assert measured["precision"] > 0.93 and measured["recall"] > 0.93


# ---- packing and mixing


def test_hilbert_neighbours_are_near():
    grid = np.array([(x, y, z) for x in range(8) for y in range(8) for z in range(8)])
    keys = packing.hilbert(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    steps = np.abs(np.diff(grid[np.argsort(keys)], axis=0)).sum(1)
    assert steps.max() == 1


def test_packing_keeps_every_token(spark):
    rnd = random.Random(10)
    texts = [prose(rnd, rnd.randint(1, 30)) for _ in range(300)] + [prose(rnd, 400), None, "", "x"]
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, capacity string")
    specs = spark.createDataFrame([(7, 512, "x"), (9000, 2048, "y")], "spec_id int, capacity_tokens int, curve string")
    enc = encoding(vocabulary_path())
    want = {i: len(enc.encode_ordinary(t or "")) for i, t in enumerate(texts)}
    rows = packing.packed(df, specs).collect()
    for spec, capacity in ((7, 512), (9000, 2048)):
        own = [r for r in rows if r["spec_id"] == spec]
        pieces: dict = {}
        boxes: dict = {}
        for r in own:
            pieces.setdefault(r["doc_id"], []).append(r["piece_tokens"])
            if r["container_id"] is not None:
                boxes.setdefault(r["container_id"], []).append(r)
        assert {i: sum(p) for i, p in pieces.items()} == want
        assert all(len(p) == max(1, -(-want[i] // capacity)) for i, p in pieces.items())
        assert all(sum(r["piece_tokens"] for r in b) == b[0]["container_tokens"] <= capacity for b in boxes.values())
        assert sum(want.values()) / (len(boxes) * capacity) > 0.85
    assert packing.packed(df.limit(0), specs).count() == 0
    with pytest.raises(ValueError):
        packing.packed(df, spark.createDataFrame([(1, None)], "spec_id int, capacity_tokens int"))


def test_mixing_reaches_shares(spark):
    rnd = random.Random(11)
    rows = [(i, prose(rnd, rnd.randint(1, 6)), "big" if i % 4 else "mid", "x") for i in range(3000)]
    rows += [(9000 + i, prose(rnd, 3), "tiny", "x") for i in range(2)] + [(9100, None, "big", "x"), (9101, "", "big", "x"), (9102, "text", "other", "x"), (9103, "text", None, "x")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, source string, n_tokens string")
    targets = spark.createDataFrame([("big", 0.4, 1), ("mid", 0.45, 5), ("tiny", 0.1, 3), ("absent", 0.05, 2)], "source string, target_share double, max_repeats int")
    mix, shares = mixing.mixed(docs, targets)
    got = {r["source"]: r for r in shares.collect()}
    assert abs(got["big"]["reached_share"] / got["mid"]["reached_share"] - 0.4 / 0.45) < 0.02
    assert got["tiny"]["most_repeats"] == 3 and got["tiny"]["mixed_documents"] == 2 and got["absent"]["mixed_tokens"] == 0
    chosen = mix.collect()
    assert sum(r["n_tokens"] for r in chosen) == sum(r["mixed_tokens"] for r in got.values())
    most: dict = {}
    for r in chosen:
        most[r["doc_id"], r["source"]] = max(most.get((r["doc_id"], r["source"]), 0), r["repeat_no"])
    caps = {"big": 1, "mid": 5, "tiny": 3}
    assert all(n <= caps[s] for (_, s), n in most.items())
    assert [r["mix_key"] for r in chosen] == sorted(r["mix_key"] for r in chosen)
    assert mixing.mixed(docs.limit(0), targets)[0].count() == 0
    with pytest.raises(ValueError):
        mixing.mixed(docs, targets.withColumn("max_repeats", targets["max_repeats"] * 0))


def test_a_huge_cap_costs_nothing(spark):
    cap = 10**9
    assert len(mixing.thresholds(3.0, cap)) < 100 and len(mixing.thresholds(3.0, 2)) == 2
    u = np.array([0.0, 0.04, 0.06, 0.5, 0.9999999])
    assert mixing.counts(3.0, cap, u).tolist() == [0, 0, 1, 3, 16] and mixing.counts(3.0, 2, u).tolist() == [0, 0, 1, 2, 2] and mixing.counts(float("inf"), 4, u).tolist() == [4] * 5
    docs = spark.createDataFrame([(i, prose(random.Random(i), 2), "ab"[i % 2]) for i in range(200)], "doc_id bigint, text string, source string")
    targets = spark.createDataFrame([("a", 0.3, cap), ("b", 0.7, cap)], "source string, target_share double, max_repeats int")
    got = {r["source"]: r["reached_share"] for r in mixing.mixed(docs, targets)[1].collect()}
    assert abs(got["a"] - 0.3) < 0.02


# ---- text statistics


def test_a_document_of_many_megabytes(spark):
    text = "The lamp is in the garden. " * 200_000
    docs = spark.createDataFrame([(1, text), (2, "The lamp is in the garden. ")], "doc_id bigint, text string")
    rows = {r["doc_id"]: r for r in text_quality.text_quality(docs, frozenset(["the", "is", "in"])).collect()}
    assert rows[1]["words"] == 1_200_000 and rows[1]["common_share"] == rows[2]["common_share"] and rows[1]["natural_prose"]


@settings(max_examples=80, deadline=None)
@given(st.text(alphabet="ab. !?\n\"1é%-", max_size=120), st.lists(st.integers(0, 120), max_size=4))
def test_states_merge_to_the_whole(text, cuts):
    common = frozenset(["ab", "a"])
    whole = text_quality.closed(text_quality.state_of(text, common), common)
    at = sorted({0, len(text), *(c for c in cuts if c <= len(text))})
    state = text_quality.state_of("", common)
    for a, b in zip(at, at[1:]):
        state = text_quality.merge(state, text_quality.state_of(text[a:b], common), common)
    assert text_quality.closed(state, common) == whole
    lines = [x for x in (re.sub(r"\s+$", "", y) for y in text.split("\n")) if x.strip()]
    assert whole[6] == len(lines) and whole[3] == len(re.findall(r"[^\W_]+", text))


def test_text_quality_in_chunks(spark):
    rnd = random.Random(12)
    rows = [(1, prose(rnd, 300)), (2, "| a | b |\n" * 30), (3, None), (4, " \n "), (5, "x" * 700), (6, prose(rnd, 1)), (None, prose(rnd, 40)), (6, "1. one\n2. two")]
    df = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id bigint, text string, words string")
    common = frozenset(["the", "of", "is", "in", "and"])
    one = text_quality.text_quality(df, common).collect()
    cut = text_quality.text_quality(df, common, chunk=64).collect()
    key = lambda r: tuple(map(str, r))
    assert sorted(one, key=key) == sorted(cut, key=key) and len(one) == len(rows)
    by = {(r["doc_id"], r["chars"]): r["natural_prose"] for r in one}
    assert by[1, len(rows[0][1])] is True and by[2, 300] is False and by[3, 0] is None and by[4, 3] is None
    assert text_quality.text_quality(df.limit(0), common).count() == 0
