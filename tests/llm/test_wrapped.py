"""License rules find texts with hard line breaks and both spellings."""

import pytest

from recollect.llm import licences


@pytest.mark.parametrize(
    "text, label",
    [
        ("GNU General\nPublic License version 3", "gpl-3.0"),
        ("GNU Lesser\n  General\n  Public License version 3", "lgpl-3.0"),
        ("The above copyright notice and this permission notice shall be included in all\ncopies or substantial portions", "mit"),
        ("licence: apache-2.0", "apache-2.0"),
        ("under the Expat\nlicence", "mit"),
        ("this is the unlicence", "unlicense"),
        ("Neither the name of the copyright holder\nnor the names of its contributors may be used to endorse\nor promote products", "bsd-3-clause"),
    ],
)
def test_rules_run_on_wrapped_texts(text, label):
    assert label in {x for _, _, x, _ in licences.scan_text(text)[2]}


def test_keywords_lose_nothing(edge_rows, texts):
    scanner = licences.scanner()
    for _, text in [*edge_rows, *texts]:
        for t in (text or "", (text or "").replace(" ", "\n")):
            lower = t.encode("utf-8", "surrogatepass").translate(licences.LOWER_AZ).decode("utf-8", "surrogatepass")
            due = {n for _, own in scanner.keywords.iter(" ".join(lower.split())) for n in own}
            assert all(n in due for n, (_, pattern) in enumerate(scanner.rules) if "licen" in lower and pattern.search(lower))


def example(pattern, space):
    """A shortest text of a pattern: first alternatives, least repeats, ``space`` for white space."""
    import re._constants as c
    import re._parser as parser

    def text(parsed):
        out = ""
        for op, arg in parsed:
            if op is c.LITERAL:
                out += chr(arg)
            elif op in (c.NOT_LITERAL, c.ANY):
                out += "x"
            elif op is c.IN:
                kind, first = arg[0]
                if (c.CATEGORY, c.CATEGORY_SPACE) in arg:
                    out += space
                else:
                    out += {c.LITERAL: lambda: chr(first), c.RANGE: lambda: chr(first[0]), c.CATEGORY: lambda: "1" if first is c.CATEGORY_DIGIT else "x"}[kind]()
            elif op in (c.MAX_REPEAT, c.MIN_REPEAT):
                out += text(arg[2]) * arg[0]
            elif op is c.SUBPATTERN:
                out += text(arg[3])
            elif op is c.BRANCH:
                out += text(arg[1][0])
            else:
                assert op in (c.ASSERT, c.ASSERT_NOT, c.AT), op
        return out

    return text(parser.parse(pattern))


@pytest.mark.parametrize("space", [" ", "\n", "\r\n   "])
def test_every_rule_runs_on_its_own_texts(space):
    scanner = licences.scanner()
    for n, (rule, pattern) in enumerate(scanner.rules):
        made = example(rule.pattern, space)
        assert pattern.search(made), rule
        assert n in {k for _, own in scanner.keywords.iter(" ".join(made.split())) for k in own}, rule
        assert scanner.detections(made), rule


def test_suppression_is_by_interval():
    found = [(-50, -3, 0, 3, "a", 1.0), (-50, -3, 5, 8, "b", 1.0), (-60, -6, 2, 8, "c", 1.0), (-40, -2, 0, 2, "d", 1.0), (-40, -8, 0, 8, "e", 1.0)]
    assert [x[2] for x in licences._outermost(found)] == ["c", "a", "e"]


def test_many_places_in_one_text():
    import time

    began = time.perf_counter()
    n, base, found = licences.scan_text("under the MIT license and " * 80_000)
    assert (n, len(base), len(found), base[-1]) == (400_000, 80_000, 80_000, (399_997, "mit"))
    assert time.perf_counter() - began < 10
