"""Licence spans: against brute force over all spans, and notices inside longer texts."""

import numpy as np

from loomstate.llm import licenses

MIT = licenses.TEMPLATES[4][1]


def scan(text):
    return licenses.scan(text, licenses.TEMPLATES, licenses.THRESHOLD)


def brute(text, templates, threshold):
    """The highest coefficient of each licence over every span of words."""
    words, best = licenses.normalised_words(text), {}
    for name, template in templates:
        grams = licenses.bigrams(licenses.normalised_words(template))
        for a in range(len(words)):
            for b in range(a + 2, len(words) + 1):
                unit = licenses.bigrams(words[a:b])
                dice = 2 * len(unit & grams) / (len(unit) + len(grams))
                if dice >= threshold:
                    best[name] = max(best.get(name, 0), dice)
    return best


def test_spans_against_brute_force():
    rng = np.random.default_rng(5)
    templates = (("x", "a b c d e f"), ("y", "c d a b a b f"), ("z", "b b a"), ("x", "d e d e f g a"))
    found = 0
    for threshold in (0.5, 0.8, 1.0):
        for _ in range(150):
            text = "".join(rng.choice(list("abcdefg"), 1)[0] + rng.choice([" ", "\n", "\n\n", ". "]) for _ in range(rng.integers(0, 30)))
            for template in templates:  # one at a time, as templates compete for words
                told = {name: dice for name, dice, *_ in licenses.scan(text, (template,), threshold)}
                assert told == brute(text, (template,), threshold)
                found += len(told)
    assert found > 100


def test_a_licence_of_paragraphs_inside_a_source_file():
    paragraphs = MIT.replace("conditions: The above", "conditions:\n\nThe above").replace("Software. THE", "Software.\n\nTHE")
    comment = "\n".join(" * " + x for x in paragraphs.replace(", ", ",\n").split("\n"))
    text = "#include <a.h>\nint b;\n/*\n * Copyright 2020 Somebody\n *\n" + comment + "\n */\nint main() { return of_the_software; }\n" * 40
    (row,) = scan(text)
    lines = text.split("\n")
    assert row[0] == "MIT" and row[1] > 0.95 and "Permission" in lines[row[2]] and "SOFTWARE" in lines[row[3]] and row[3] < 60


def test_a_notice_inside_a_line():
    assert scan("Some prose ends the paragraph here. Released under the MIT License.") == [("MIT", 1.0, 0, 0)]
    assert scan("More\nprose. Released under\n\nthe MIT License. And so on.") == [("MIT", 1.0, 1, 3)]


def test_many_copies_of_a_notice_take_no_long_time():
    assert scan("Released under the MIT License. " * 4000) == [("MIT", 1.0, 0, 0)]


def names(text):
    return [name for name, *_ in scan(text)]


def test_whole_licences():
    for name in licenses.WHOLE:
        text = next(t for n, t in reversed(licenses.TEMPLATES) if n == name)
        source = "int a;\n\n/*\n" + "\n".join(" * " + x for x in text.split("\n")) + "\n */\nint b;\n"
        (found,) = scan(source)
        assert found[:2] == (name, 1.0) and found[3] - found[2] > 0.9 * text.strip().count("\n")


def test_bsd_of_a_named_holder():
    two, three = (next(t for n, t in reversed(licenses.TEMPLATES) if n == f"BSD-{k}-Clause") for k in (2, 3))
    assert names("Copyright (c) 2001 Some Company\nAll rights reserved.\n\n" + three.replace("the copyright holder nor", "the Some Company, Incorporated, nor").replace("COPYRIGHT HOLDERS AND", "REGENTS AND")) == ["BSD-3-Clause"]
    assert names(two.replace("1.", "*").replace("2.", "*").replace("COPYRIGHT HOLDER OR", "AUTHOR OR")) == ["BSD-2-Clause"]


def test_standard_headers_name_one_version():
    for kind, version, name in (("", "1", "GPL-1.0"), ("", "2", "GPL-2.0"), ("", "3", "GPL-3.0"), ("Library ", "2", "LGPL-2.0"), ("Lesser ", "2.1", "LGPL-2.1"), ("Lesser ", "3", "LGPL-3.0"), ("Affero ", "3", "AGPL-3.0")):
        grant = f"This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU {kind}General Public License as published by\nthe Free Software Foundation; either version {version} of the License, or\n(at your option) any later version.\n"
        assert names(grant) == [name]
        header = grant + f"\nThis program is distributed in the hope that it will be useful,\nbut WITHOUT ANY WARRANTY; without even the implied warranty of\nMERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the\nGNU {kind}General Public License for more details.\n"
        assert names(header) == [name]
        (found,) = scan(header + f"\nYou should have received a copy of the GNU {kind}General Public License\nalong with this program.  If not, see <http://www.gnu.org/licenses/>.\n")
        assert (found[0], found[2], found[3]) == (name, 0, 11)
    assert names("Licensed under the Apache License, Version 1.1.") == ["Apache-1.1"]
    assert names("Licensed under CC BY-SA 3.0.") == ["CC-BY-SA-3.0"]


def test_notices_side_by_side_are_all_kept():
    assert names("Released under the MIT License. Licensed under CC BY 4.0.") == ["CC-BY-4.0", "MIT"]
    assert names("This work is licensed under the GNU General Public License, version 3. " * 3 + "This work is licensed under the GNU General Public License, version 2.") == ["GPL-2.0", "GPL-3.0"]
    assert licenses.scan("x a b c d y", (("p", "a b c d"), ("q", "a b c d")), 0.8) == [("p", 1.0, 0, 0), ("q", 1.0, 0, 0)]
