import random
import re

from tessera.llm.licenses import DEFAULT_NOTICES, Scanner, bands_needed, scan_licenses


def plain(t):
    return re.findall(r"[0-9a-z\u0080-\U0010ffff]+", "".join(c.lower() if c < "\x80" else c for c in t))


def shingles(w):
    return {tuple(w[j : j + 5]) for j in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)}


def test_bands():
    assert bands_needed(1.0) == 1
    for j in (0.2, 0.5, 0.9):
        assert 1 - (1 - j) ** bands_needed(j, 0.9999) >= 0.9999


def test_planted_notices_are_found(spark):
    r = random.Random(4)
    rows, want = [], set()
    for i in range(250):
        name = r.choice(sorted(DEFAULT_NOTICES))
        w = plain(DEFAULT_NOTICES[name])
        edited = list(w)
        for _ in range(len(w) // 50):
            edited[r.randrange(len(w))] = "changed"
        if len(shingles(w) & shingles(edited)) / len(shingles(w)) >= 0.75:
            want.add((i, name))
        noise = lambda: [f"word{r.randrange(3000)}" for _ in range(r.randrange(250))]
        rows.append((i, " ".join([*noise(), *edited, *noise()]).replace(" changed ", ", CHANGED; "), "clash"))
    rows += [(900, None, None), (901, "", None), (None, "(Released under the MIT License.)", None), (902, "free " * 60000, None), (903, "MIT License", None)]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string, license string")).collect()
    found = {(g.doc_id, g.license) for g in got}
    assert want <= found and (None, "MIT-line") in found
    texts = {i: plain(t or "") for i, t, _ in rows}
    for g in got:
        wanted = shingles(plain(DEFAULT_NOTICES[g.license]))
        span = texts[g.doc_id][g.first_word : g.end_word]
        assert g.containment >= 0.75 and abs(len(shingles(span) & wanted) / len(wanted) - g.containment) < 1e-9
    assert not [g for g in got if g.doc_id in (900, 901, 902, 903)]


def test_own_templates_and_empty_table(spark):
    templates = {"short": "all rights reserved", "line": "do what you want with this"}
    got = scan_licenses(spark.createDataFrame([(1, "x All rights reserved"), (2, "all RIGHTS, reserved."), (3, "so: do what you want with this ok")], "doc_id long, text string"), templates)
    # a short template is found inside a longer text as well
    assert {(g.doc_id, g.license) for g in got.collect()} == {(1, "short"), (2, "short"), (3, "line")}
    assert len(Scanner(templates).groups) >= 1
    assert scan_licenses(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_short_notices_inside_long_texts(spark):
    templates = {"one": "Copyleft", "three": "all rights reserved", "four": "SPDX-License-Identifier: MIT", "twice": "la la", "line": "do what you want with this", "none": "..."}
    rows = [
        (1, "x All rights reserved"), (2, "noise " * 400 + "ALL rights, reserved. " + "noise " * 400), (3, "// SPDX-License-Identifier: MIT\nint main"), (4, "all rights"),
        (5, "reserved; copyleft all rights reserved, all rights reserved"), (6, "la la la"), (7, None), (8, "rights reserved"), (9, "so: do what you want with this ok"), (10, "all"), (11, "all rights reserved"),
    ]
    got = scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), templates).collect()
    assert sorted(tuple(g) for g in got) == [
        (1, "three", 1, 4, 1.0), (2, "three", 400, 403, 1.0), (3, "four", 0, 4, 1.0), (5, "one", 1, 2, 1.0), (5, "three", 2, 5, 1.0), (5, "three", 5, 8, 1.0),
        (6, "twice", 0, 3, 1.0), (9, "line", 1, 7, 1.0), (11, "three", 0, 3, 1.0),
    ]


def test_default_notices_hold_the_families(spark):
    lines = ["All rights reserved.", "Licensed under CC BY 4.0", "Licensed under CC BY-SA 4.0"]
    names = ["All-rights-reserved", "CC-BY-4.0-line", "CC-BY-SA-4.0-line", "CC0-1.0", "BSD-3-Clause", "LGPL-3.0-or-later", "AGPL-3.0-or-later"]
    texts = [*lines, *(DEFAULT_NOTICES[n] for n in names[3:])]
    got = scan_licenses(spark.createDataFrame([(i, f"before it {t} after it") for i, t in enumerate(texts)], "doc_id long, text string")).collect()
    best = {}
    for g in got:
        best.setdefault(g.doc_id, []).append((g.containment, g.license))
    assert all((1.0, n) in best[i] for i, n in enumerate(names))


def best_stretch(words, wanted, length):
    """Greatest part of the template's shingles in any stretch of so many words."""
    every = [tuple(words[j : j + 5]) for j in range(len(words) - 4)]
    return max((len(set(every[j : j + length]) & wanted) / len(wanted) for j in range(max(1, len(every) - length + 1))), default=0.0)


def test_matches_with_insertions_are_all_found(spark):
    """Whatever holds three quarters of a notice in a stretch of one and a half times its length is found."""
    r = random.Random(9)
    rows, want = [], set()
    names = [n for n in sorted(DEFAULT_NOTICES) if len(plain(DEFAULT_NOTICES[n])) >= 12]
    for i in range(400):
        name = r.choice(names)
        w = plain(DEFAULT_NOTICES[name])
        text = list(w)
        for _ in range(2):
            at = r.randrange(1, len(text))
            text[at:at] = [f"ins{r.randrange(99)}" for _ in range(r.randint(1, max(1, len(w) // 6)))]
        noise = lambda: [f"word{r.randrange(3000)}" for _ in range(r.randrange(120))]
        text = [*noise(), *text, *noise()]
        if best_stretch(text, shingles(w), int(1.5 * (len(w) - 4))) >= 0.75:
            want.add((i, name))
        rows.append((i, " ".join(text)))
    one = {(g.doc_id, g.license) for g in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1)).collect()}
    many = {(g.doc_id, g.license) for g in scan_licenses(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert len(want) > 150 and want <= one
    assert one == many  # what a text's neighbours are makes no difference


def test_bands_for_low_containment():
    for least in (0.02, 0.1, 0.75, 1.0):
        for g in Scanner(DEFAULT_NOTICES, least).groups:
            assert g.bands >= 1 and g.window % g.stride == 0
            small = min(len(Scanner(DEFAULT_NOTICES, least).sets[i]) for i in g.names[:1])
            assert g.stride <= max(1, least * small + 1)
