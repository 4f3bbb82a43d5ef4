from recordloom.llm import licenses


def test_blocks_and_findings():
    s = licenses.Scanner()
    text = "Some prose here.\nReleased under the MIT License.\nMore prose.\nLicensed under CC BY-NC 4.0.\n"
    n, found = s.scan(text)
    assert n >= 2
    assert [(f["license"], text[f["start"] : f["end"]]) for f in found if f["license"] == "MIT"] == [("MIT", "Released under the MIT License.")]
    assert {f["license"] for f in found} == {"MIT", "CC-BY-NC-4.0"}
    assert all(not f["missing"] and not f["extra"] for f in found)


def test_every_template_is_found_and_only_it():
    s = licenses.Scanner()
    for name, text in licenses.TEMPLATES.items():
        _, found = s.scan(f"first line\n{text}\nlast line")
        assert name in [f["license"] for f in found], name
        assert not [f for f in found if f["missing"] or f["extra"]]


def test_versions_and_families_are_told_apart():
    s = licenses.Scanner()
    for text, want in (
        ("This work is licensed under the GNU General Public License, version 2.", "GPL-2.0"),
        ("This work is licensed under the GNU Lesser General Public License, version 3.", "LGPL-3.0"),
        ("Licensed under CC BY-SA 4.0.", "CC-BY-SA-4.0"),
    ):
        assert [f["license"] for f in s.scan(text)[1]] == [want]


def test_small_wording_differences_are_reported():
    s = licenses.Scanner()
    (f,) = s.scan("this work is now licensed under the gnu general public license version 3")[1]
    assert f["license"] == "GPL-3.0" and f["extra"] == ["now"] and f["missing"] == []


def test_talk_about_licenses_is_no_license():
    s = licenses.Scanner()
    for text in ("You need a fishing license for that lake.", "The copyright debate goes on.", "Permission slips are due.", "", None, "no cue"):
        assert s.scan(text)[1] == []


def test_ranking_agrees_with_compression():
    s = licenses.Scanner()
    saved = s.saved(licenses.TEMPLATES["GPL-3.0"])
    assert max(saved, key=saved.get) == "GPL-3.0"


def test_documents(spark, odd, none, small):
    rows = licenses.scan_licenses(odd).collect()
    assert len(rows) == odd.count() and all(r.findings == [] and r.n_candidates == 0 for r in rows)
    assert licenses.scan_licenses(none).count() == 0
    found = {r.doc_id: r for r in licenses.op5_licenses(spark, small).collect()}
    docs = spark.read.parquet(f"{small}/documents.parquet").collect()
    assert len(found) == len(docs)
    for d in docs:  # plain search for the exact notices
        want = sorted(n for n, t in licenses.TEMPLATES.items() if t in d.text.split("\n"))
        assert sorted(x for x in found[d.doc_id].licenses.split(",") if x) == want


def test_all_notices_of_one_line_are_found():
    s = licenses.Scanner()
    gpl = "This work is licensed under the GNU General Public License, version 3."
    for text, want in (
        (f"{gpl} All rights reserved.", ["GPL-3.0", "Proprietary"]),
        (f"{gpl} Released under the MIT License.", ["GPL-3.0", "MIT"]),
        ("All rights reserved. Licensed under CC BY-NC 4.0.", ["Proprietary", "CC-BY-NC-4.0"]),
        (f"Released under the MIT License. Licensed under the Apache License, Version 2.0. {gpl}", ["MIT", "Apache-2.0", "GPL-3.0"]),
        (" ".join(licenses.TEMPLATES.values()), [k for k in licenses.TEMPLATES]),
    ):
        found = s.scan(f"The permission of the work is general.\nThe work, {text} And so on.")[1]
        assert [f["license"] for f in found] == want
        assert not any(f["missing"] or f["extra"] for f in found)


def test_alignment_takes_the_fewest_differing_words():
    s = licenses.Scanner()
    # the missing first word stands far before the notice, too
    (f,) = s.scan("Released last year, and it stays under the same roof: available under the MIT License now.")[1]
    assert (f["license"], f["missing"], f["extra"]) == ("MIT", ["released"], [])


def test_wrapped_notices_are_found():
    s = licenses.Scanner()
    for text, want in (
        ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:", "BSD-2-Clause"),
        ("Licensed under\nCC BY 4.0.", "CC-BY-4.0"),
        ("All rights\nreserved.", "Proprietary"),
        ("All rights\r\n  reserved.", "Proprietary"),
        ("# All rights\n# reserved.", "Proprietary"),
        ("This is free and unencumbered software released into the public\ndomain.", "Unlicense"),
    ):
        for around in ("{}", "One line.\n{}\nAnother.", "A paragraph.\n\n{}\n\nAnother.", "word " * 3000 + "\n{}\n" + "word " * 3000):
            whole = around.format(text)
            n, (f,) = s.scan(whole)
            assert n and (f["license"], f["missing"], f["extra"]) == (want, [], [])
            assert licenses.words(whole[f["start"] : f["end"]]) == licenses.words(licenses.TEMPLATES[want])
    assert list(licenses.blocks("All rights\nreserved. Released under the MIT License.")) == [(11, 52), (0, 52)]
    assert list(licenses.blocks("All rights reserved.\n\nNo cue\nhere")) == [(0, 20)]
    for name, text in licenses.TEMPLATES.items():
        for split in range(1, len(text.split())):
            w = text.split()
            found = s.scan("Prose.\n" + " ".join(w[:split]) + "\n" + " ".join(w[split:]) + "\nProse.")[1]
            assert [f["license"] for f in found if not f["missing"] and not f["extra"]] == [name]


def test_every_occurrence_is_kept(spark, tmp_path):
    text = "Now released under the MIT License.\n\nWord available under the MIT License.\nAll rights reserved. All rights reserved.\n" + "word " * 50 + "\nReleased under the MIT License. Released under the MIT License."
    _, found = licenses.Scanner().scan(text)
    assert [(f["license"], len(f["missing"]) + len(f["extra"])) for f in found] == [("MIT", 0), ("MIT", 1), ("Proprietary", 0), ("Proprietary", 0), ("MIT", 0), ("MIT", 0)]
    assert len({(f["start"], f["end"]) for f in found}) == 6
    spark.createDataFrame([(1, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    (r,) = licenses.op5_licenses(spark, str(tmp_path)).collect()
    assert (r.n_found, r.licenses, r.spans.count(","), r.n_differing) == (6, "MIT,Proprietary", 5, 1)


def test_tags_headers_and_spelling():
    s = licenses.Scanner()
    cases = (
        ("// SPDX-License-Identifier: MIT", ["SPDX-License-Identifier: MIT"]),
        ("/* SPDX-License-Identifier: (Apache-2.0 OR GPL-2.0-or-later) */".replace("(", "", 1), ["SPDX-License-Identifier: Apache-2.0", "SPDX-License-Identifier: GPL-2.0-or-later"]),
        ("# SPDX-License-Identifier: GPL-2.0 WITH Linux-syscall-note\nint x;", ["SPDX-License-Identifier: GPL-2.0", "SPDX-License-Identifier: Linux-syscall-note"]),
        ("Released under the MIT licence.", ["MIT"]),
        (" * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version.", ["GPL-3.0-or-later-header"]),
        ("Licensed under the EUPL, Version 1.2 only", ["EUPL-1.2"]),
    )
    for text, want in cases:
        n, found = s.scan(text)
        assert n and [f["license"] for f in found] == want, text
        assert all(text[f["start"] : f["end"]].lower().strip(".") for f in found)


def test_findings_equal_a_plain_search():
    """Every stretch of every line against every template, by plain edit distance without substitutions."""
    import random

    rng = random.Random(8)
    names = ["MIT", "GPL-3.0", "CC-BY-4.0", "Proprietary", "BSD-3-Clause"]
    s = licenses.Scanner({k: licenses.TEMPLATES[k] for k in names})

    def distance(want, have):
        cost = [[i + j if not i or not j else 0 for j in range(len(have) + 1)] for i in range(len(want) + 1)]
        for i, w in enumerate(want, 1):
            for j, h in enumerate(have, 1):
                cost[i][j] = min(cost[i - 1][j] + (99 if licenses._tells(w) else 1), cost[i][j - 1] + (99 if licenses._tells(h) else 1), cost[i - 1][j - 1] if w == h else 999)
            cost[i][0] = sum(99 if licenses._tells(x) else 1 for x in want[:i])
        return cost[-1][-1]

    for _ in range(60):
        name = rng.choice(names)
        words = licenses.TEMPLATES[name].split()
        for _ in range(rng.randint(0, 2)):
            if rng.random() < 0.5:
                words.insert(rng.randrange(1, len(words)), rng.choice(["really", "x", "license", "mit"]))
            else:
                del words[rng.randrange(len(words))]
        line = " ".join(["filler", *words, "tail", "license"])
        have = [w for w, _, _ in licenses._placed(licenses._lower(line))]
        for template in names:
            want = s.words[template]
            most = int(licenses.TOLERANCE * len(want))
            best = min((distance(want, have[a:b]) for a in range(len(have)) for b in range(a + 1, len(have) + 1)), default=99)
            found = [f for f in s.scan(line)[1] if f["license"] == template]
            if best <= most and not any(f["license"] != template for f in s.scan(line)[1]):
                assert found and min(len(f["missing"]) + len(f["extra"]) for f in found) == best, (line, template)
            if best > most:
                assert not found, (line, template)


def test_blocks_are_compressed_with_every_template_and_confirmed_by_rank(monkeypatch):
    compressed, confirmed = [], []
    saved, stretches = licenses.Scanner.saved, licenses.Scanner.stretches
    monkeypatch.setattr(licenses.Scanner, "saved", lambda self, block, names=None: compressed.append((block, names)) or saved(self, block, names))
    monkeypatch.setattr(licenses.Scanner, "stretches", lambda self, name, have: confirmed.append(name) or stretches(self, name, have))
    s = licenses.Scanner()
    block = "All rights reserved. " + licenses.TEMPLATES["GPL-3.0"] + " Released under the MIT License."
    _, found = s.scan(block)
    by = saved(s, block)
    assert compressed[0] == (block, None) and set(by) == set(licenses.TEMPLATES)
    assert confirmed == sorted(confirmed, key=lambda k: (-by[k], k)) and {"Proprietary", "GPL-3.0", "MIT"} <= set(confirmed)
    assert [f["license"] for f in found] == ["Proprietary", "GPL-3.0", "MIT"]
    assert all(f["rank"] == 1 + sum((-by[k], k) < (-by[f["license"]], f["license"]) for k in by) for f in found)
    assert all(s.ranked(t)[0] == name for name, t in licenses.TEMPLATES.items() if name in ("GPL-3.0", "BSL-1.0", "Unlicense", "EPL-2.0"))
