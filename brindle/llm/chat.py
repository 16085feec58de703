"""Chat formatting: roles of a transcript's turns by a hidden Markov model, then canonical rendering.

A state is a role and whether the line begins a turn or goes on with it. A line
is seen as a speaker marker ("User:", "### Assistant", "[system]", ...), whether
the line before is blank, a bin of its length and whether it asks, lists or
quotes code. Transitions and line features are estimated from turns of known
roles, as counts over all of them; the most likely path (Viterbi) gives the
turns, and markers are taken off before they are rendered.

A long conversation is worked on in segments, and its path is still one: each
segment's best scores from any state of its first line to any state of the next
segment's first line are a matrix of six by six, such matrices are chained
(maximum of sums) in order, by groups of groups, and then every segment is
decoded between the two states that the best path has at its ends.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brindle.llm.common import hinted, kept, table, unused, written

ROLES = ("system", "user", "assistant")
#: Names by which transcripts call the roles.
NAMES = {
    "system": ("system", "instruction", "instructions", "context"),
    "user": ("user", "human", "customer", "question", "me", "q"),
    "assistant": ("assistant", "bot", "ai", "model", "agent", "answer", "gpt", "a"),
}
_ROLE_OF = {name: i for i, role in enumerate(ROLES) for name in NAMES[role]}
_MARKER = re.compile(rf"\s{{0,8}}(?:[#>*\[<(|-]{{1,6}}\s?)?({'|'.join(sorted(_ROLE_OF, key=len, reverse=True))})(?:\s?(?:[\]>)*|]{{1,4}}\s?:?|:)(?:\*{{1,2}})?)(?:\s+|$)", re.IGNORECASE)
#: A marker's chance at the beginning of a turn, of naming the right role, and within a turn.
MARKED, RIGHT, QUOTED = 0.85, 0.97, 1e-4
#: Turns of a conversation that are decoded together, segments that are chained in one go, and bins of a line's length (powers of two of characters).
SEGMENT, FAN, BINS = 256, 1024, 12
SMOOTH = 1.0
#: Long conversations whose ids are broadcast at most.
LONG_AT_ONCE = 1_000_000
NEVER = -1e9


def _length_bin(length: int) -> int:
    return min(BINS - 1, length.bit_length())


def _kind(line: str) -> int:
    """0 plain, 1 asks, 2 lists or quotes code."""
    text = line.strip()
    return 1 if text.endswith("?") else 2 if text[:1] in ("-", "*", "`", "#", "|") or text[:2].rstrip(".)").isdigit() else 0


def line_counts(turns: DataFrame, role: str = "role", text: str = "text") -> DataFrame:
    """Rows (role, begins, after_blank, bin, kind, n) over all lines of turns with a known role; a table of bounded size."""
    known = turns.where(F.lower(F.trim(F.col(role))).isin(*ROLES)).select(F.lower(F.trim(F.col(role))).alias("role"), F.split(F.coalesce(F.col(text), F.lit("")), "\n").alias("lines"))
    each = known.select("role", "lines", F.posexplode("lines").alias("at", "line"))
    stripped = F.trim("line")
    length = F.char_length("line")
    size = F.when(length == 0, 0).otherwise(F.least(F.lit(BINS - 1), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double")) + 1e-9) + 1)).cast("int")
    kind = F.when(stripped.endswith("?"), 1).when(stripped.rlike(r"^(?:[-*`#|]|[0-9][0-9.)](?:[^0-9]|$)|[0-9]$)"), 2).otherwise(0)
    blank = F.when(F.col("at") == 0, F.lit(True)).otherwise(F.trim(F.get("lines", F.col("at") - 1)) == "")
    return each.select("role", (F.col("at") == 0).alias("begins"), blank.alias("after_blank"), size.alias("bin"), kind.alias("kind")).groupBy("role", "begins", "after_blank", "bin", "kind").agg(F.count("*").alias("n"))


class Model:
    """Log chances: start (role), follow (role, role), end of a turn after a line, and of what is seen of a line in each state."""

    def __init__(self, lines: list[tuple], follow: list[tuple]):
        """lines: rows of line_counts(); follow: (role before or None, role, n)."""
        n = len(ROLES)
        at = {role: i for i, role in enumerate(ROLES)}
        start, step = np.full(n, SMOOTH), np.full((n, n), SMOOTH)
        for before, role, count in follow:
            if before is None:
                start[at[role]] += count
            else:
                step[at[before], at[role]] += count
        begins, stays = np.full(n, SMOOTH), np.full(n, SMOOTH)
        blank = np.full((n, 2, 2), SMOOTH)
        size, kind = np.full((n, 2, BINS), SMOOTH), np.full((n, 2, 3), SMOOTH)
        for role, begin, after, b, k, count in lines:
            i, s = at[role], 0 if begin else 1
            (begins if begin else stays)[i] += count
            blank[i, s, int(after)] += count
            size[i, s, b] += count
            kind[i, s, k] += count
        log = lambda x: np.log(x / x.sum(-1, keepdims=True))
        self.start, self.step = log(start), log(step)
        self.ends, self.goes_on = np.log(begins / (begins + stays)), np.log(stays / (begins + stays))
        self.blank, self.size, self.kind = log(blank), log(size), log(kind)

    def seen(self, marker: int | None, after_blank: bool, length: int, kind: int) -> np.ndarray:
        """Log chance of a line in each state: roles that begin, then roles that go on."""
        out = np.concatenate([self.blank[:, s, int(after_blank)] + self.size[:, s, length] + self.kind[:, s, kind] for s in (0, 1)])
        n = len(ROLES)
        if marker is None:
            out[:n] += math.log(1 - MARKED)
            out[n:] += math.log(1 - QUOTED)
        else:
            out[:n] += math.log(MARKED * (1 - RIGHT) / (n - 1))
            out[marker] += math.log(RIGHT * (n - 1) / (1 - RIGHT))
            out[n:] += math.log(QUOTED)
        return out

    def observed(self, lines: list[str]) -> tuple[np.ndarray, list]:
        """Log chances (lines x states) and the marker at the head of each line; the first line stands at a beginning."""
        markers = [_MARKER.match(line) for line in lines]
        seen = []
        for i, (line, match) in enumerate(zip(lines, markers, strict=True)):
            body = line[match.end() :] if match else line
            seen.append(self.seen(_ROLE_OF[match[1].lower()] if match else None, i == 0 or not lines[i - 1].strip(), _length_bin(len(body)), _kind(body)))
        return np.array(seen), markers

    @property
    def move(self) -> np.ndarray:
        """Log chances from state to state: a turn ends and another begins, or it goes on."""
        n = len(ROLES)
        once = np.hstack([self.ends[:, None] + self.step, np.where(np.eye(n, dtype=bool), self.goes_on[:, None], NEVER)])
        return np.vstack([once, once])

    @property
    def first(self) -> np.ndarray:
        return np.concatenate([self.start, np.full(len(ROLES), NEVER)])

    def chain(self, lines: list[str], last: bool) -> np.ndarray:
        """Best scores from each state of the first line to each of the next segment's first line; of the last segment, to its end (all columns are equal)."""
        seen, move = self.observed(lines)[0], self.move
        score = np.where(np.eye(len(move), dtype=bool), seen[0][:, None], NEVER)
        for x in seen[1:]:
            score = (score[:, :, None] + move).max(1) + x
        return np.repeat(score.max(1)[:, None], len(move), 1) if last else (score[:, :, None] + move).max(1)

    def path(self, seen: np.ndarray, first: np.ndarray, behind: np.ndarray) -> list[int]:
        """The best states; first: scores of those of the first line, behind: what each state of the last line adds."""
        move, score, back = self.move, first + seen[0], []
        for x in seen[1:]:
            into = score[:, None] + move
            back.append(into.argmax(0))
            score = into.max(0) + x
        found = [int((score + behind).argmax())]
        for pointers in reversed(back):
            found.append(int(pointers[found[-1]]))
        return found[::-1]

    def parse(self, transcript: str | None) -> list[tuple[str, str]]:
        """Turns (role, text) in order; none for a null or blank transcript."""
        return self.parse_between((transcript or "").split("\n"), None, None)[1]

    def parse_between(self, lines: list[str], entry: int | None, leave: int | None) -> tuple[bool, list[tuple[str, str]], bool]:
        """Whether the first turn goes on from before, the turns, and whether the last one goes on behind.

        entry and leave are the states of the first line and of the line behind the
        last one; None is the beginning or the end of the conversation.
        """
        if entry is None and leave is None and not any(line.strip() for line in lines):
            return False, [], False
        n = len(ROLES)
        seen, markers = self.observed(lines)
        first = self.first if entry is None else np.where(np.arange(2 * n) == entry, 0.0, NEVER)
        path = self.path(seen, first, np.zeros(2 * n) if leave is None else self.move[:, leave])
        turns: list[tuple[int, list[str]]] = []
        for state, line, match in zip(path, lines, markers, strict=True):
            if state < n or not turns:
                turns.append((state % n, [line[match.end() :] if match and state < n else line]))
            else:
                turns[-1][1].append(line)
        before, behind = entry is not None and entry >= n, leave is not None and leave >= n
        texts = ["\n".join(text) for _, text in turns]
        texts = [t if before and i == 0 else t.lstrip() for i, t in enumerate(texts)]
        texts = [t if behind and i + 1 == len(texts) else t.rstrip() for i, t in enumerate(texts)]
        return before, [(ROLES[role], text) for (role, _), text in zip(turns, texts, strict=True)], behind


def best_chain(links: list[np.ndarray], first: np.ndarray, leave: int) -> list[int]:
    """The state that the best path has at the head of each of the matrices; first: scores of states at the head of the first one."""
    score, back = first, []
    for link in links:
        into = score[:, None] + link
        back.append(into.argmax(0))
        score = into.max(0)
    at = [leave]
    for pointers in reversed(back):
        at.append(int(pointers[at[-1]]))
    return at[:0:-1]


def render(turns: list[tuple[str, str]], before: bool = False, behind: bool = False) -> str:
    """Canonical form of turns; of a segment whose first turn goes on from before, or whose last one goes on behind, without the mark there."""
    heads = ["" if before and i == 0 else f"<|{role}|>\n" for i, (role, _) in enumerate(turns)]
    tails = ["\n" if behind and i + 1 == len(turns) else "\n<|end|>\n" for i in range(len(turns))]
    return "".join(f"{head}{text}{tail}" for head, (_, text), tail in zip(heads, turns, tails, strict=True))


def learn(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> Model:
    """Estimate a model from turns; unknown and null roles and conversations are left out of the counts."""
    lines = [tuple(r) for r in line_counts(turns, role, text).collect()]
    named = turns.where(F.lower(F.trim(F.col(role))).isin(*ROLES) & F.col(conv).isNotNull() & F.col(turn).isNotNull()).select(F.col(conv).alias("c"), F.col(turn).alias("t"), F.lower(F.trim(F.col(role))).alias("role"))
    # the turn before is looked up by its number, so no conversation is gathered
    once = named.groupBy("c", "t").agg(F.min("role").alias("role"))
    pairs = once.alias("x").join(once.select("c", (F.col("t") + 1).alias("t"), F.col("role").alias("before")).alias("y"), ["c", "t"], "left")
    follow = [tuple(r) for r in pairs.groupBy("before", "role").agg(F.count("*").alias("n")).collect()]
    return Model(lines, follow)


def _numbered(rows: DataFrame, segment: int) -> DataFrame:
    """Rows (conv, segment, turns) of conversations of any length, by places counted in blocks: no task sees a whole conversation.

    A cell is the rows of one turn number, or where one number has very many rows
    (null, say) a range of their hashes; the places of cells come from the sums of
    blocks of turn numbers.
    """
    most = rows.groupBy("conv", "turn").agg(F.count("*").alias("n")).agg(F.max("n")).first()[0]
    rows = rows.withColumn("cell", F.floor(F.col("order") * F.lit(-(-most // segment)) / F.lit(float(1 << 32))))
    counts = kept(rows.select("conv", "turn", "cell", F.xxhash64("role", "text").alias("h")).distinct().groupBy("conv", "turn", "cell").agg(F.count("*").alias("n")))
    counts = counts.withColumn("block", F.floor(F.col("turn") / 1024))
    blocks = counts.groupBy("conv", "block").agg(F.sum("n").alias("s"))
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(F.col("conv").alias("c"), F.col("block").alias("b"), F.coalesce(F.sum("s").over(before(Window.partitionBy("conv").orderBy("block"))), F.lit(0)).alias("start"))
    within = F.coalesce(F.sum("n").over(before(Window.partitionBy("conv", "block").orderBy("turn", "cell"))), F.lit(0)).alias("within")
    starts = counts.select("conv", "turn", "cell", "block", within).join(blocks, F.col("conv").eqNullSafe(F.col("c")) & F.col("block").eqNullSafe(F.col("b")))
    starts = starts.select(F.col("conv").alias("c"), F.col("turn").alias("t"), F.col("cell").alias("x"), (F.col("start") + F.col("within")).alias("start"))
    cells = rows.groupBy("conv", "turn", "cell").agg(F.sort_array(F.collect_set(F.struct("turn", "order", "role", "text"))).alias("turns"))
    placed = cells.join(starts, F.col("conv").eqNullSafe(F.col("c")) & F.col("turn").eqNullSafe(F.col("t")) & F.col("cell").eqNullSafe(F.col("x")))
    each = placed.select("conv", "start", F.posexplode("turns").alias("i", "one")).select("conv", (F.col("start") + F.col("i")).alias("place"), "one")
    return each.groupBy("conv", F.floor(F.col("place") / segment).alias("segment")).agg(F.sort_array(F.collect_list("one")).alias("turns"))


def transcripts(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", segment: int = SEGMENT) -> DataFrame:
    """Rows (conv, segment, last, n_turns, transcript): each conversation's turns as text, with the role as a marker where it is known.

    Repeated rows count once; turns of equal number are in the order of a hash of
    role and text, null numbers come first. Rows with a null conversation are one
    conversation. A conversation of more than segment rows comes in segments of
    as many turns, from 0; they joined by an empty line are the whole.
    """
    order = F.pmod(F.xxhash64(role, text), F.lit(1 << 32))
    rows = turns.select(F.col(conv).alias("conv"), F.col(turn).alias("turn"), order.alias("order"), F.col(role).alias("role"), F.col(text).alias("text"))
    long = kept(rows.groupBy("conv").agg(F.count("*").alias("n")).where(F.col("n") > segment).select(F.col("conv").alias("c")))
    whole = lambda r: r.groupBy("conv").agg(F.lit(0).cast("long").alias("segment"), F.sort_array(F.collect_set(F.struct("turn", "order", "role", "text"))).alias("turns"))
    if long.isEmpty():
        grouped = whole(rows)
    else:
        few, same = hinted(long, LONG_AT_ONCE), F.col("conv").eqNullSafe(F.col("c"))
        grouped = whole(rows.join(few, same, "left_anti")).unionByName(_numbered(rows.join(few, same, "left_semi"), segment))
        grouped = written(grouped, "transcripts")
    marked = lambda x: F.concat(F.when(F.length(F.trim(x["role"])) > 0, F.concat(F.initcap(F.trim(x["role"])), F.lit(": "))).otherwise(""), F.coalesce(x["text"], F.lit("")))
    out = grouped.select("conv", "segment", F.size("turns").cast("long").alias("n_turns"), F.array_join(F.transform("turns", marked), "\n\n").alias("transcript"))
    if not long.isEmpty():
        ends = grouped.groupBy("conv").agg(F.max("segment").alias("end"))
        out = out.join(hinted(kept(ends.where("end > 0").select(F.col("conv").alias("c"), "end")), LONG_AT_ONCE), F.col("conv").eqNullSafe(F.col("c")), "left").withColumn("last", F.coalesce(F.col("segment") == F.col("end"), F.lit(True)))
    else:
        out = out.withColumn("last", F.lit(True))
    return out.select(F.col("conv").alias(conv), "segment", "last", "n_turns", "transcript")


def _lines(transcript: str | None, last: bool) -> list[str]:
    """Lines of a segment; the empty one between it and the next is its own."""
    return (transcript or "").split("\n") + ([] if last else [""])


def _chains(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            links = [model.chain(_lines(x.as_py(), last), last).reshape(-1) for x, last in zip(batch.column(2), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(links, pa.list_(pa.float64()))], ["conv", "at", "link"])

    return run


def _links(rows: pa.Table) -> list[np.ndarray]:
    return [np.array(x).reshape(2 * len(ROLES), -1) for x in rows.column("link").to_pylist()]


def _together(fan: int):
    """One matrix for consecutive ones."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        links = _links(rows)
        total = links[0]
        for link in links[1:]:
            total = (total[:, :, None] + link).max(1)
        return pa.table({"conv": rows.column("conv").slice(0, 1), "at": pa.array([rows.column("at")[0].as_py() // fan]), "link": pa.array([total.reshape(-1)], pa.list_(pa.float64()))})

    return run


def _ends(first: np.ndarray):
    """For consecutive matrices and the states around them: the states around each."""

    def run(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("at")
        entry, leave = rows.column("entry")[0].as_py(), rows.column("leave")[0].as_py()
        start = first if entry is None else np.where(np.arange(len(first)) == entry, 0.0, NEVER)
        heads = best_chain(_links(rows), start, leave or 0)
        entries = [entry, *heads[1:]]
        return pa.table({"conv": rows.column("conv"), "at": rows.column("at"), "entry": pa.array(entries, pa.int32()), "leave": pa.array([*heads[1:], leave], pa.int32())})

    return run


def routes(rows: DataFrame, model: Model, fan: int = FAN) -> DataFrame:
    """Rows (conv, at, entry, leave): for each segment of long conversations the states of its first line and of the next one's; null is the beginning or the end."""
    kind = rows.schema["conv"].dataType.simpleString()
    link, ends = f"conv {kind}, at bigint, link array<double>", f"conv {kind}, at bigint, entry int, leave int"
    levels = [kept(rows.select("conv", "segment", "transcript", "last").mapInArrow(_chains(model), link))]
    while (levels[-1].agg(F.max("at")).first()[0] or 0) >= fan:
        levels.append(kept(levels[-1].groupBy("conv", F.floor(F.col("at") / fan)).applyInArrow(_together(fan), link)))
    none = F.lit(None).cast("int")
    found = levels[-1].withColumns({"entry": none, "leave": none}).groupBy("conv").applyInArrow(_ends(model.first), ends)
    for level in reversed(levels[:-1]):
        above = found.select(F.col("conv").alias("c"), F.col("at").alias("up"), "entry", "leave")
        below = level.join(above, F.col("conv").eqNullSafe(F.col("c")) & (F.floor(F.col("at") / fan) == F.col("up"))).drop("c")
        found = below.groupBy("conv", "up").applyInArrow(_ends(model.first), ends)
    return found


def _parsed(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(i) for i in range(4)]
            found = [model.parse_between(_lines(x.as_py(), last), entry, leave) for x, last, entry, leave in zip(columns[0], *(c.to_pylist() for c in columns[1:]), strict=True)]
            kept_ = [batch.column(i) for i in range(4, batch.num_columns)]
            new = [pa.array([[t[i] for t in turns] for _, turns, _ in found], pa.list_(pa.string())) for i in (0, 1)]
            chat = pa.array([render(turns, before, behind) for before, turns, behind in found], pa.string())
            yield pa.RecordBatch.from_arrays([*kept_, *new, chat, pa.array([b for b, _, _ in found], pa.bool_())], [*batch.schema.names[4:], "roles", "texts", "chat", "continues"])

    return run


def parsed(rows: DataFrame, model: Model, conv: str = "conv_id", fan: int = FAN) -> DataFrame:
    """transcripts() with roles and texts (arrays) of the turns and chat, their canonical form.

    A segment's chat goes on where the one before it has ended, so in order they
    are the whole (but for blank lines at a cut within a turn); continues says that its first turn began in the segment before.
    Columns of rows but segment, last and transcript may have any other name.
    """
    keep = [c for c in rows.columns if c not in ("transcript", "last", "roles", "texts", "chat", "continues")]
    none = F.lit(None).cast("int")
    long = rows.where(~F.col("last") | (F.col("segment") > 0))
    if long.isEmpty():
        chosen = rows.withColumns({"entry": none, "leave": none})
    else:
        found = routes(long.withColumnRenamed(conv, "conv"), model, fan).select(F.col("conv").alias("c"), "at", "entry", "leave")
        between = long.join(found, F.col(conv).eqNullSafe(F.col("c")) & (F.col("segment") == F.col("at"))).drop("c", "at")
        chosen = rows.where(F.col("last") & (F.col("segment") == 0)).withColumns({"entry": none, "leave": none}).unionByName(between)
    chosen = chosen.select(F.col("transcript"), F.col("last"), F.col("entry"), F.col("leave"), *[F.col(c).alias(c if c not in ("entry", "leave") else unused(c, rows)) for c in keep])
    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in chosen.schema.fields[4:])
    return chosen.mapInArrow(_parsed(model), f"{fields}roles array<string>, texts array<string>, chat string, continues boolean")


def _joined(c: str) -> Column:
    return F.array_join(c, ",")


def op4_role_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations")
    found = parsed(transcripts(turns), learn(turns))
    begun = F.size("roles") - F.col("continues").cast("int")
    return found.select("conv_id", "segment", "n_turns", begun.cast("long").alias("n_parsed"), "continues", _joined("roles").alias("roles"), "chat")


QUERIES = {"op4_role_hmm": op4_role_hmm}
