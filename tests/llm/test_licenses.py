import textwrap

import pytest

from terralit.llm import licenses

LONG = [(k, t) for k, ts in licenses.TEMPLATES.items() for t in ts if len(t) > 90]


@pytest.mark.parametrize("lead", ["", " * ", "# "])
def test_wrapped_notices(spark, lead):
    rows = [(i, "Some words.\n" + textwrap.fill(t, 60, initial_indent=lead, subsequent_indent=lead) + "\nThe end.") for i, (_, t) in enumerate(LONG)]
    got = licenses.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((x.doc_id, x.line, x.license, x.exact) for x in got) == [(i, 1, k, True) for i, (k, _) in enumerate(LONG)]


def test_phrasings_and_tags():
    scan = licenses.Scanner().scan
    for text, want in [("Licensed under the MIT License.", ["MIT"]), ("SPDX-License-Identifier: MIT", ["MIT"]), ("// SPDX-License-Identifier: (GPL-2.0-or-later OR MIT)", ["GPL-2.0", "MIT"]),
                       ("Distributed under the BSD\n3-Clause License", ["BSD-3-Clause"]), ("license = \"Apache-2.0\"", ["Apache-2.0"]), ("All rights\nreserved.", ["proprietary"]), ("a license: none\nMIT students", [])]:
        assert [x[1] for x in scan(text)] == want, text


def test_long_regions():
    text = "word licence here\n" * 9000 + textwrap.fill(licenses._MIT, 60) + "\nmore licensed words" * 9000
    assert [x[:2] for x in licenses.Scanner().scan(text)] == [(9000, "MIT")]


NOTICE = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."


def test_licenses_are_told_apart():
    scan = licenses.Scanner().scan
    for text, want in [(NOTICE.format("General Public License", 2), "GPL-2.0"), (NOTICE.format("General Public License", 3), "GPL-3.0"), (NOTICE.format("Affero General Public License", 3), "AGPL-3.0"),
                       (NOTICE.format("Lesser General Public License", 2.1).replace("program", "library"), "LGPL-2.1"), (NOTICE.format("Library General Public License", 2).replace("program", "library"), "LGPL-2.0"),
                       (NOTICE.format("Lesser General Public License", 3), "LGPL-3.0"), (NOTICE.format("General Public License", 4), None), ("Licensed under CC BY-NC-SA 4.0.", "CC-BY-NC-SA-4.0"), ("Licensed under CC BY 9.0.", None),
                       ("This work is licensed under a Creative Commons Attribution - NonCommercial 4.0 International License.", "CC-BY-NC-4.0"), ("Licensed under the Apache License, Version 1.1.", None)]:
        for t in (text, textwrap.fill(text, 60)):
            assert [x[1] for x in scan(t)] == [want] * (want is not None), t
