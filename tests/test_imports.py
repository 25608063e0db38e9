"""Imports over several lines, and the whole lists of test packages."""

import ast
import random

import pytest

from siftwork.operators import imports


def artifacts(spark, sources):
    return spark.createDataFrame(list(enumerate(sources)), "path int, content string")


def found(df):
    return sorted({(r["path"], r["line"], r["name"], r["package"]) for r in df.collect()}, key=str)


def test_lists_are_those_of_the_reference():
    assert {k: len(v) for k, v in imports.TEST_PACKAGES.items()} == {"PYTHON": 9, "GO": 10, "JAVA": 22, "JAVASCRIPT": 20, "TYPESCRIPT": 20, "CSHARP": 27}
    assert "FluentAssertions" in imports.TEST_PACKAGES["CSHARP"] and "nose" not in imports.TEST_PACKAGES["PYTHON"]


def test_python_imports_equal_those_of_the_parser(spark):
    r = random.Random(5)
    names = ["a", "b as c", "x_1", "mock as m"]
    kinds = [
        lambda: f"import {r.choice(['os', 'nox.sub', 'a.b as c', 'os, sys as s'])}",
        lambda: f"from {r.choice(['pytest', '.x', 'a.b'])} import {', '.join(r.sample(names, 2))}  # why (not)",
        lambda: f"from p.q import ({', '.join(r.sample(names, 3))})",
        lambda: "from pytest import (\n    " + ",  # it (is)\n    ".join(r.sample(names, 3)) + ",\n)",
        lambda: "from pytest import(\n\n    " + ",\n".join(r.sample(names, 2)) + ")",
        lambda: "from os import a, \\\n    b as c",
        lambda: "from os \\\n  import a",
        lambda: "import os, \\\n  sys as s",
        lambda: "import os; from a import b; x = 1",
        lambda: "x = (1,\n  2)  # ends \\",
        lambda: "import os; from q import (a,\n b)",
        lambda: "",
    ]
    sources = ["\n".join(r.choice(kinds)() for _ in range(r.randint(1, 12))) for _ in range(60)] + [""]
    want = set()
    for i, source in enumerate(sources):
        for n in ast.walk(ast.parse(source)):
            if isinstance(n, ast.Import):
                want |= {(i, n.lineno, a.asname, a.name) for a in n.names}
            elif isinstance(n, ast.ImportFrom):
                want |= {(i, n.lineno, a.asname or a.name, "." * n.level + (n.module or "")) for a in n.names}
    assert found(imports.python_imports(artifacts(spark, sources))) == sorted(want, key=str)


@pytest.mark.parametrize("language,source,want", [
    ("JAVASCRIPT", 'import {\n  a, // one "x"\n  b as c,\n} from "chai";\nimport d from "sinon"', [(1, "a", "chai"), (1, "b", "chai"), (5, "d", "sinon")]),
    ("JAVASCRIPT", 'x()\nconst {\n  a,\n  b\n} =\n  require(\n"tape")\n', [(2, "a", "tape"), (2, "b", "tape")]),
    ("TYPESCRIPT", 'import x from "x"; import {\n  a\n} from "mocha"', [(1, "x", "x"), (1, "a", "mocha")]),
    ("TYPESCRIPT", "import\n  e\n  from\n  'enzyme'\nlet y = 1", [(1, "e", "enzyme")]),
    ("JAVASCRIPT", 'import a from "x"; import b from "ava"', [(1, "a", "x"), (1, "b", "ava")]),
    ("GO", 'import (\n\t"fmt"\n\tm "go.uber.org/mock"\n)\nimport ("os"; "testing")', [(2, "fmt", "fmt"), (3, "m", "go.uber.org/mock"), (5, "os", "os"), (5, "testing", "testing")]),
    ("JAVA", "import java.util.List;\nimport static org\n  .assertj.core\n  .Api.*;import io.cucumber.X;", [(1, "List", "java.util"), (2, None, "org.assertj.core.Api"), (2, "X", "io.cucumber")]),
    ("CSHARP", "using System; using F =\n  FluentAssertions.\n  Core;\nusing (var x = y) { }", [(1, None, "System"), (1, "F", "FluentAssertions.Core")]),
])
def test_imports_over_several_lines(spark, language, source, want):
    got = found(imports.IMPORTS[language](artifacts(spark, [source])))
    assert got == sorted([(0, *w) for w in want], key=str)
    assert imports.test_by_imports(artifacts(spark, [source]), language).count() == 1
