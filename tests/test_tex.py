"""Attribution of TeX errors: logs line by line in plain Python, and the cases in which a log must not be believed."""

import posixpath
import re

import pytest
from pyspark.sql import functions as F

from brindle import registry
from brindle.operators import texlog
from brindle.plans.tex import tex_runs

SF = "/root/testdata/sf0.001"
CLOSING = ["Here is how much of TeX's memory you used:", " 1 string", " 2 strings"]
SUMMARY = "Collected error summary (may duplicate other messages):"


def plain(log: str, files: dict, main_dir: str, errored: bool, others=()):
    """(file, line, excerpt) of one log, read line by line."""
    lines = re.split(r"\r\n|\r|\n", re.sub(r"(\r\n|\r|\n)\Z", "", log)) if log else []

    def ways(line):
        for m in re.finditer(r":([0-9]+): ", line):
            if m.start():
                printed = line[: m.start()]
                yield posixpath.normpath(printed if printed[0] == "/" else posixpath.join(main_dir, printed)), int(m[1]), line[m.end() :].strip(" ")

    def places(line):
        return {(p, n): s for p, n, s in ways(line) if p in files}

    ends = [i for i, x in enumerate(lines) if x.startswith(CLOSING[0])]
    shaped = [i for i, x in enumerate(lines) if x.startswith("!") or places(x)]
    reports = [i for i, x in enumerate(lines[: ends[-1]] if ends else []) if not re.match(r"\s|<|l\.[0-9]", x) and (x.startswith("!") or any(p in files or p in others for p, _, _ in ways(x)))]
    if len(reports) > 1:
        return None, None, "\n".join(lines[max(reports[0], ends[-1] - 40) : ends[-1]])
    start = shaped[0] if shaped else None
    if reports and (start is None or reports[0] > start + 11):
        start = reports[0]
    if start is None:
        return None, None, "No TeX error line was found in the log. Its last lines were:\n\n" + "\n".join(lines[-40:])
    excerpt = "\n".join(lines[start : start + 12])
    if not reports:
        return None, None, excerpt
    if not errored:
        return None, None, "The document produced no pages, and TeX reported no error.\n\n" + "\n".join(lines[-40:]) if "No pages of output." in lines else excerpt
    at = reports[0]
    spot = places(lines[at])
    if len(spot) != 1:
        return None, None, excerpt
    ((file, number), message), = spot.items()
    last = [x for x in lines if "==> Fatal error occurred" in x]
    good = message != "Emergency stop." and (not last or list(places(last[-1])) == [(file, number)])
    good = good and any(x == f"l.{number}" or x.startswith(f"l.{number} ") for x in lines[at + 1 : at + 11]) and 1 <= number <= files[file]
    return (file, number, excerpt) if good else (None, None, excerpt)


def test_query_against_a_loop(spark):
    found = {r.doc_id: r for r in registry.queries()["tex_log_attribution"](spark, SF).collect()}
    runs = tex_runs(spark, SF).collect()
    assert len(found) == len(runs)
    for r in runs:
        errored = "gave return code" in r.stdout
        file, line, excerpt = plain(r.log, {f.path: f.n_lines for f in r.files}, r.main_dir, errored)
        assert (found[r.doc_id].file, found[r.doc_id].line) == (file, line), r.doc_id
        assert found[r.doc_id].excerpt == excerpt, r.doc_id
    assert {r.verdict for r in found.values()} >= {"found", "ambiguous", "uncorroborated", "not errored", "no place"}


REPORT = "./chapters/intro.tex:21: Undefined control sequence."
FATAL = "./chapters/intro.tex:21:  ==> Fatal error occurred, no output PDF file produced!"
#: name, lines, more existing files, errored, what must come out
CASES = [
    ("chapter", ["chatter", REPORT, "l.21 \\x", *CLOSING, FATAL], (), True, ("chapters/intro.tex", 21, "found")),
    ("no last words", ["chatter", REPORT, "<recently read> \\y", "", "l.21", *CLOSING], (), True, ("chapters/intro.tex", 21, "found")),
    ("colon in a name", ["./chapters/a:b.tex:2: Undefined.", "l.2 \\x", *CLOSING], (), True, ("chapters/a:b.tex", 2, "found")),
    ("space in a name", ["./my chapter/deep.tex:2: Undefined.", "l.2 \\x", *CLOSING], (), True, ("my chapter/deep.tex", 2, "found")),
    ("quoted path", ["./main.tex:4: ./none.tex:3: boom", "l.4 ...s/intro.tex:3: boom", *CLOSING], (), True, ("main.tex", 4, "found")),
    ("echoed prose", ["[]\\OT1/cmr/m/n/10 chap-ters/intro.tex:5: Un-de-fined", REPORT, "l.21 \\x", *CLOSING], (), True, ("chapters/intro.tex", 21, "found")),
    ("two places in a line", ["./main.tex:4: b.tex:3: boom", "l.4", "l.3", *CLOSING], (), True, (None, None, "no place")),
    ("forged before", ["./main.tex:1: Undefined.", "l.1 \\z", REPORT, "l.21 \\x", *CLOSING], (), True, (None, None, "ambiguous")),
    ("forged far behind", [REPORT, "l.21 \\x", *["pad"] * 60, "./main.tex:3: Undefined.", "l.3 \\zz", *CLOSING], (), True, (None, None, "ambiguous")),
    ("made by the run", ["./generated.tex:3: boom", "./main.tex:3: boom", "l.3 \\x", *CLOSING], ("generated.tex",), True, (None, None, "ambiguous")),
    ("in the installation", ["/usr/tex/a.sty:9: boom", "./main.tex:3: boom", "l.3 \\x", *CLOSING], (), True, (None, None, "ambiguous")),
    ("fallout", ["./main.tex:3: Emergency stop.", "l.3 \\begin{document}", *CLOSING], (), True, (None, None, "fallout")),
    ("last words differ", [REPORT, "l.21 \\x", *CLOSING, "./main.tex:3:  ==> Fatal error occurred"], (), True, (None, None, "contradicted")),
    ("no number below", [REPORT, *["help"] * 10, "l.21 \\x", *CLOSING], (), True, (None, None, "uncorroborated")),
    ("zeros in front", [REPORT, "l.021 \\x", *CLOSING], (), True, (None, None, "uncorroborated")),
    ("file too short", ["./main.tex:10: Undefined.", "l.10 \\x", *CLOSING], (), True, (None, None, "beyond the file")),
    ("line nought", ["./main.tex:0: Undefined.", "l.0 \\x", *CLOSING], (), True, (None, None, "beyond the file")),
    ("bare message", ["! File ended while scanning use of \\x.", *CLOSING], (), True, (None, None, "no place")),
    ("forged without an error", [REPORT, "l.21 \\x", "No pages of output.", *CLOSING], (), False, (None, None, "no pages")),
    ("engine ended well", [REPORT, "l.21 \\x", *CLOSING], (), False, (None, None, "not errored")),
    ("no closing block", [REPORT, "l.21 \\x"], (), True, (None, None, "no report")),
    ("behind the closing block", [*CLOSING, REPORT, "l.21 \\x"], (), True, (None, None, "no report")),
    ("nothing", ["all is well", *CLOSING], (), True, (None, None, "no error")),
    ("many colons", [":1: " * 3000 + "x", REPORT, "l.21 \\x", *CLOSING], (), True, ("chapters/intro.tex", 21, "found")),
    ("empty", [], (), True, (None, None, "no error")),
]
FILES = {"main.tex": 9, "chapters/intro.tex": 21, "chapters/a:b.tex": 3, "my chapter/deep.tex": 3, "main.tex:4: b.tex": 3}


def test_cases(spark):
    lines = [(name, i, x) for name, log, *_ in CASES for i, x in enumerate(log)]
    staged = spark.createDataFrame([(c[0], p, n) for c in CASES for p, n in FILES.items()], "log string, path string, n_lines bigint")
    runs = spark.createDataFrame([(c[0], None, c[3]) for c in CASES], "log string, main_dir string, errored boolean")
    present = spark.createDataFrame([(c[0], p) for c in CASES for p in c[2]], "log string, path string")
    found = {r.log: r for r in texlog.attribute(spark.createDataFrame(lines, "log string, at int, line string"), staged, runs, present, ("/usr/tex/",)).collect()}
    for name, log, others, errored, wanted in CASES:
        r = found[name]
        assert (r.file, r.line, r.verdict) == wanted, name
        if "installation" not in name:
            assert (r.file, r.line, r.excerpt) == plain("\n".join(log), FILES, "", errored, others), name


def test_paths_are_relative_to_the_main_file(spark):
    lines = spark.createDataFrame([(1, i, x) for i, x in enumerate(["../shared/./a.tex:2: Undefined.", "l.2 \\x", *CLOSING])], "log int, at int, line string")
    staged = spark.createDataFrame([(1, "shared/a.tex", 5), (1, "a.tex", 5)], "log int, path string, n_lines bigint")
    runs = spark.createDataFrame([(1, "paper", True), (2, "", True)], "log int, main_dir string, errored boolean")
    rows = {r.log: (r.file, r.line, r.verdict) for r in texlog.attribute(lines, staged, runs).collect()}
    assert rows == {1: ("shared/a.tex", 2, "found"), 2: (None, None, "no error")}


@pytest.mark.parametrize(
    ("stdout", "engine", "failed"),
    [
        (f"x\n{SUMMARY}\n  pdflatex: Command for 'pdflatex' gave return code 1\n      Refer\nLatexmk: end", "pdflatex", True),
        (f"{SUMMARY}\n  bibtex main: errors\n  xelatex: Command for 'xelatex' gave return code 12", "xelatex", True),
        (f"{SUMMARY}\n  pdflatex: Command for 'pdflatex' gave return code 1", "lualatex", True),
        (f"{SUMMARY}\n  pdflatex: Command for 'pdflatex' gave return code 1", "xelatex", False),
        (f"{SUMMARY}\n  pdflatex: failed to create output file", "pdflatex", False),
        (f"{SUMMARY}\n  pdflatex: Command for 'pdflatex' gave return code 0", "pdflatex", False),
        (f"{SUMMARY}\n  bibtex Command for 'pdflatex' gave return code 1: errors: See 'Command for 'pdflatex' gave return code 1.blg'", "pdflatex", False),
        (f"{SUMMARY}\nLatexmk: end\n  pdflatex: Command for 'pdflatex' gave return code 1", "pdflatex", False),
        (f"{SUMMARY}\n  pdflatex: Command for 'pdflatex' gave return code 1\n{SUMMARY}\n  none", "pdflatex", False),
        (f"Running '{SUMMARY}'\n  pdflatex: Command for 'pdflatex' gave return code 1", "pdflatex", False),
        (SUMMARY, "pdflatex", False),
        ("", "pdflatex", False),
        (None, None, False),
    ],
)
def test_driver_summary(spark, stdout, engine, failed):
    row = spark.createDataFrame([(stdout, engine)], "stdout string, engine string").select(texlog.engine_failed(F.col("stdout"), F.col("engine")).alias("failed")).first()
    assert row.failed is failed


def test_texts_are_split_once(spark, monkeypatch):
    """All steps read one written table of runs: the plan of the result no longer reaches the documents."""
    from brindle.plans import tex

    seen = []
    attribute = texlog.attribute
    monkeypatch.setattr(texlog, "attribute", lambda *frames: seen.extend(frames) or attribute(*frames))
    tex.tex_log_attribution(spark, SF)
    assert len(seen) == 3
    for frame in seen:
        assert not [f for f in frame.inputFiles() if f.endswith("documents.parquet")]
