"""Secret scans with DataFrame functions alone.

Base kinds are patterns, matched leftmost and without overlap. Besides, candidate strings (long runs of letters, digits
and + / _ = -, outside base spans) are scanned by a sliding window: the Shannon entropy of the window follows from the
sum of c * log2(c) over the counts c of its characters. The counts are carried along, a few bits for each character in
a handful of numbers: one goes up as a character enters, one goes down as one leaves, and the sum changes by two
looked-up values. A candidate's threshold is that of its character class; an allow-list takes out what is harmless.

All of it is linear in the text but for sorting and running sums (n log n): places are running sums by doubling, no
list or string grows by one piece at a time, and a long candidate goes in blocks that overlap by a window.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from nearway.llm.common import unwrapped, wrapped

#: The base kinds in their order; group 2 of assign and group 0 of the others have a least length.
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"  # 20 characters and more; a shorter run can hold no later match
HEX = r"[0-9a-f]{24,}"
KINDS = ("assign", "access", "hex", "entropy")
ASSIGN_LEAST = 6

CANDIDATE = r"[A-Za-z0-9+/_=-]{20,}"
WINDOW = 20
#: Least entropy of a window in bits, by character class: the first class that fits a candidate counts.
CLASSES = (("^[0-9a-fA-F]+$", 3.0), ("^[A-Z0-9]+$", 3.4), ("^[a-z0-9]+$", 3.4), ("", 3.7))
#: Candidates that are no secrets: without a digit or without a letter, UUIDs, paths and dates joined by dashes.
ALLOWED = (r"^[^0-9]*$", r"^[^A-Za-z]*$", r"^[0-9a-fA-F]{8}(-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}$", r"^[a-z]+(?:[-_/][a-z]+)*+[-_/]?[0-9]{1,8}$")
#: Words that make the part of a path (or the run) that holds them harmless, and no more than that part.
ALLOWED_WORDS = ("example", "sample", "placeholder")
#: Characters of a candidate, and of a masked text, that are looked at together.
BLOCK = 4_096
#: What stands for each character of a span in a masked text, and for each of an allowed word's part.
HIDDEN, HARMLESS = "\uffff", " "


def _none(kind: str) -> Column:
    return F.expr(f"cast(array() as array<{kind}>)")


def _running(lengths: Column) -> Column:
    """Running sums of an array of numbers, each with its own, in as many rounds as the logarithm of its size."""

    def doubled(sums: Column, step: Column) -> Column:
        return F.transform(sums, lambda x, i: F.when(i >= step, x + F.get(sums, (i - step).cast("int"))).otherwise(x))

    steps = F.transform(F.sequence(F.lit(0), F.ceil(F.log2(F.size(lengths) + 1)).cast("int")), lambda k: F.pow(F.lit(2), k).cast("int"))
    return F.when(F.size(lengths) < 2, lengths).otherwise(F.aggregate(steps, lengths, doubled))


def _matches(docs: DataFrame, text: str, patterns: dict[str, tuple], **more: Column) -> DataFrame:
    """docs with an array for each name of all matches: gap (the text before it), match, start, end and whether it counts.

    patterns has a pattern for each name, a group and the least length of it. The text between matches and the matches
    alternate, so the running sum of their lengths gives the places. `name`_rest is the text after the last match.
    """
    t, first, parts, ends, found = F.col(text), {}, {}, {}, {}
    none = _none("struct<gap:string,match:string,ok:boolean,start:bigint,end:bigint>")
    for name, (pattern, group, least) in patterns.items():
        p, hit = F.lit(pattern), t.rlike(pattern)
        first[f"{name}_gaps"] = F.when(hit, F.split(t, pattern, -1))
        first[f"{name}_all"] = F.when(hit, F.regexp_extract_all(t, p, F.lit(0)))
        if group:
            first[f"{name}_group"] = F.when(hit, F.regexp_extract_all(t, p, F.lit(group)))
        all_ = F.col(f"{name}_all")
        pairs = F.arrays_zip(all_.alias("m"), F.col(f"{name}_group").alias("g")) if group else F.transform(all_, lambda m: F.struct(m.alias("m"), m.alias("g")))
        part = lambda b, x, least=least: F.struct(b.alias("gap"), x["m"].alias("match"), (F.length(x["g"]) >= least).alias("ok"), (F.length(b) + F.length(x["m"])).cast("long").alias("n"))
        parts[f"{name}_parts"] = F.zip_with(F.slice(f"{name}_gaps", 1, F.size(all_)), pairs, lambda b, x: part(b, x))  # noqa: B023
        ends[f"{name}_ends"] = _running(F.transform(f"{name}_parts", lambda x: x["n"]))
        placed = F.zip_with(f"{name}_parts", f"{name}_ends", lambda x, e: F.struct(x["gap"].alias("gap"), x["match"].alias("match"), x["ok"].alias("ok"), (e - F.length(x["match"])).alias("start"), e.alias("end")))
        found |= {name: F.coalesce(placed, none), f"{name}_rest": F.when(F.col(f"{name}_gaps").isNotNull(), F.element_at(f"{name}_gaps", -1)).otherwise(t)}
    for level in (first, parts, ends, found):
        docs = docs.withColumns(level)
    return docs.drop(*first, *parts, *ends)


def _masked(matches: str, instead) -> Column:
    """The text that _matches() was given, with instead(match) in place of each match."""
    return F.when(F.size(matches) == 0, F.col(f"{matches}_rest")).otherwise(F.concat(F.array_join(F.transform(matches, lambda m: F.concat(m["gap"], instead(m))), ""), F.col(f"{matches}_rest")))


def _hidden(n: Column) -> Column:
    return F.repeat(F.lit(HIDDEN), n.cast("int"))


def _both(docs: DataFrame, name: str, one: str, other: str) -> DataFrame:
    """docs with the text of `one`, hidden wherever `one` or `other`, which are as long, is hidden; in blocks."""
    blocks = lambda c: F.regexp_extract_all(F.col(c), F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0))
    hidden = lambda a, b: F.when(b == HIDDEN, b).otherwise(a)
    merged = F.array_join(F.zip_with(blocks(one), blocks(other), lambda a, b: F.when(F.contains(b, F.lit(HIDDEN)), F.array_join(F.zip_with(F.split(a, ""), F.split(b, ""), hidden), "")).otherwise(a)), "")
    return docs.withColumn(name, F.when(F.contains(F.col(other), F.lit(HIDDEN)), merged).otherwise(F.col(one)))


def _hot(judged: str, window: int) -> Column:
    """For each candidate and block, first and last place (from 0, end exclusive) of windows whose sum is `most` at most.

    -1 where there is none. The fold's state has the window's sum, its counts (c0, c1, ...), and first and last place so
    far; a step adds what the state's own sum says of the window that ends at its place, and then moves on by one. It is
    written as SQL, for a plan of so many columns takes seconds to make one by one.
    """
    bits, chars = window.bit_length(), "+-/=_" + "".join(chr(c) for a, b in ("09", "AZ", "az") for c in range(ord(a), ord(b) + 1))
    each = 63 // bits  # counts that share a number
    numbers = range(-(-len(chars) // each))
    # by a character's code: the number that has its count, the place there, and a 1 at that place
    codes = [(k // each, k % each * bits) for k in (max(chars.find(chr(c)), 0) for c in range(128))]
    w, s = (f"array({', '.join(str(x[i]) for x in codes)})" for i in (0, 1))
    f = [round(c * math.log2(c) * 2**40) if c else 0 for c in range(window + 1)]
    gains = "array(" + ", ".join(f"{b - a}L" for a, b in zip(f, f[1:], strict=False)) + ")"  # from a count to the next
    count = lambda x: "shiftright(CASE " + " ".join(f"WHEN {x}.w = {j} THEN acc.c{j}" for j in numbers) + f" END, {x}.s) & {2**bits - 1}L"
    moved = ", ".join(f"'c{j}', acc.c{j} + IF(p.e.w = {j}, p.e.b, 0L) - IF(p.l.w = {j}, p.l.b, 0L)" for j in numbers)
    high = f"acc.at >= {window} AND acc.sum <= c.most"
    seen = f"'first', IF(acc.first < 0 AND {high}, acc.at - {window}, acc.first), 'last', IF({high}, acc.at, acc.last)"
    step = f"""named_struct('at', acc.at + 1,
        'sum', acc.sum + get({gains}, CAST({count("p.e")} AS int) - IF(p.l IS NOT NULL AND p.e.w = p.l.w AND p.e.s = p.l.s, 1, 0)) - IF(p.l IS NULL, 0L, get({gains}, CAST({count("p.l")} AS int) - 1)),
        {seen}, {moved})"""
    zero = "named_struct('at', 0, 'sum', 0L, 'first', -1, 'last', -1" + "".join(f", 'c{j}', 0L" for j in numbers) + ")"
    places = f"transform(split(b, ''), x -> named_struct('w', get({w}, ascii(x)), 's', get({s}, ascii(x)), 'b', shiftleft(1L, get({s}, ascii(x)))))"
    # a fold of one step binds the places, which are zipped with themselves a window later
    pairs = f"aggregate(array(0), {places}, (own, x) -> own, own -> zip_with(own, slice(concat(array_repeat(NULL, {window}), own), 1, size(own)), (e, l) -> named_struct('e', e, 'l', l)))"
    # a block begins with the last characters of the one before, so that no window is missed
    lead = f"IF(i > 0, right(get(c.blocks, i - 1), {window - 1}), '')"
    return F.expr(f"transform({judged}, c -> transform(transform(c.blocks, (b, i) -> concat({lead}, b)), b -> aggregate({pairs}, {zero}, (acc, p) -> {step}, acc -> named_struct({seen}))))")


def _scanned(docs: DataFrame, found: str, name: str, window: int, classes, allowed) -> DataFrame:
    """docs with the array `name`: each candidate's gap and match, its start, and first and last place of high entropy."""
    harmless = "|".join(f"(?:{p})" for p in allowed)

    def judged(c: Column) -> Column:
        most = lambda bits: F.lit(int((math.log2(window) - bits) * window * 2.0**40) + 1024)  # noqa: E731  1024: rounding
        limit = most(classes[-1][1])
        for pattern, bits in reversed(classes[:-1]):
            limit = F.when(c["match"].rlike(pattern), most(bits)).otherwise(limit)
        cut = F.when(F.length(c["match"]) <= BLOCK, F.array(c["match"])).otherwise(F.regexp_extract_all(c["match"], F.lit(f".{{1,{BLOCK}}}"), F.lit(0)))
        fine = c["match"].rlike(harmless) if harmless else F.lit(False)
        return F.struct(limit.alias("most"), F.when(fine, _none("string")).otherwise(cut).alias("blocks"))

    before = lambda i: i * BLOCK - F.when(i > 0, window - 1).otherwise(0)
    least = lambda h: F.array_min(F.transform(h, lambda x, i: F.when(x["first"] >= 0, x["first"] + before(i))))
    last = lambda h: F.array_max(F.transform(h, lambda x, i: F.when(x["first"] >= 0, x["last"] + before(i))))
    out = docs.withColumn("_judged", F.transform(found, judged)).withColumn("_hits", _hot("_judged", window))
    out = out.withColumn("_ends", F.transform("_hits", lambda h: F.struct(F.coalesce(least(h), F.lit(-1)).alias("first"), F.coalesce(last(h), F.lit(-1)).alias("last"))))
    return out.withColumn(name, F.zip_with(found, "_ends", lambda c, e: F.struct(c["gap"].alias("gap"), c["match"].alias("match"), c["start"].alias("start"), e["first"].alias("first"), e["last"].alias("last")))).drop("_judged", "_hits", "_ends")


def scan(docs: DataFrame, text_col: str = "text", window: int = WINDOW, classes=CLASSES, allowed=ALLOWED, words=ALLOWED_WORDS) -> DataFrame:
    """row (all columns of docs as a struct), text, base_spans, spans (base and added) and hidden of every row.

    Spans are arrays of structs start, kind, end in code points, end exclusive, by start and then kind; kinds are
    numbers, the places in KINDS. hidden is the text with HIDDEN for every character of a span. Candidates for added
    spans are what lies outside base spans, so the rest of a run that holds a base span is scanned on its own. Null and
    empty texts have no spans; rows are kept as they are, repeated ones too; columns of docs may have any names.
    """
    out = docs.select(wrapped(docs), F.col(text_col).alias("text")).withColumn("_t", F.coalesce("text", F.lit("")))
    base = ("_assign", "_access", "_hex")
    out = _matches(out, "_t", dict(zip(base, ((ASSIGN, 2, ASSIGN_LEAST), (ACCESS, 0, 0), (HEX, 0, 0)), strict=True)))

    def span(kind: int):
        return lambda m: F.struct(m["start"].alias("start"), F.lit(kind).alias("kind"), m["end"].alias("end"))

    spans = [F.transform(F.filter(name, lambda m: m["ok"]), span(k)) for k, name in enumerate(base)]
    kept = lambda m: F.when(m["ok"], _hidden(F.length(m["match"]))).otherwise(m["match"])
    out = out.withColumns({"base_spans": F.array_sort(F.concat(*spans)), **{f"{name}_hidden": _masked(name, kept) for name in base}})
    out = _both(_both(out, "_base", "_assign_hidden", "_access_hidden"), "_base", "_base", "_hex_hidden").select("row", "text", "base_spans", "_base")
    # an allowed word hides its part of a path from the scan; the part is read from its first character, and so once
    part = "[A-Za-z0-9+_=-]"
    if words:
        out = _matches(out, "_base", {"_words": (f"(?i)(?<!{part}){part}*?(?:{'|'.join(words)}){part}*", 0, 0)})
        out = out.withColumn("_open", _masked("_words", lambda m: F.repeat(F.lit(HARMLESS), F.length(m["match"])))).drop("_words", "_words_rest")
    else:
        out = out.withColumn("_open", F.col("_base"))
    out = _scanned(_matches(out, "_open", {"_runs": (CANDIDATE, 0, 0)}), "_runs", "_found", window, classes, allowed)
    added = F.transform(F.filter("_found", lambda c: c["first"] >= 0), lambda c: F.struct((c["start"] + c["first"]).alias("start"), F.lit(3).alias("kind"), (c["start"] + c["last"]).alias("end")))
    shown = lambda c: F.when(c["first"] < 0, c["match"]).otherwise(F.concat(F.left(c["match"], c["first"]), _hidden(c["last"] - c["first"]), F.right(c["match"], F.length(c["match"]) - c["last"])))
    made = F.when(F.size("_found") == 0, F.col("_open")).otherwise(F.concat(F.array_join(F.transform("_found", lambda c: F.concat(c["gap"], shown(c))), ""), F.col("_runs_rest")))
    out = out.withColumns({"spans": F.array_sort(F.concat("base_spans", added)), "_added": made})
    return _both(out, "hidden", "_base", "_added").select("row", "text", "base_spans", "spans", "hidden")


def written(spans: str) -> Column:
    """kind:start:end of each span, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def report(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Id, base spans by kind, the base spans' digest and all spans as text, for every row."""
    found = scan(docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))).withColumn("doc_id", F.col("row.doc_id"))
    n = lambda k: F.size(F.filter("base_spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", n(0).alias("n_assign"), n(1).alias("n_access"), n(2).alias("n_hex"), F.sha2(written("base_spans").cast("binary"), 256).alias("base_sha256"), written("spans").alias("spans"))


def redact(docs: DataFrame, text_col: str = "text", mark: str = "[SECRET]") -> DataFrame:
    """docs with every span replaced by the mark (spans that overlap or touch by one mark); n_chars follows if there is one.

    A text that holds HIDDEN itself, which is no character of any script, loses it beside or inside a span alone: such
    a text is cut by places.
    """
    text = F.col("text")

    def step(acc: Column, s: Column) -> Column:
        new = s["start"] > acc["at"]
        gap = F.substring(text, (acc["at"] + 1).cast("int"), F.greatest(s["start"] - acc["at"], F.lit(0)).cast("int"))
        put = F.when(new, F.array(gap, F.lit(mark))).when(F.size(acc["out"]) == 0, F.array(F.lit(mark))).otherwise(_none("string"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.concat(acc["out"], put).alias("out"))

    by_place = F.aggregate("spans", F.expr("named_struct('at', 0L, 'out', cast(array() as array<string>))"), step, lambda a: F.concat(F.array_join(a["out"], ""), F.substring(text, (a["at"] + 1).cast("int"), F.length(text))))
    plain = F.regexp_replace("hidden", f"{HIDDEN}+", mark.replace("\\", "\\\\").replace("$", "\\$"))
    hit = F.size("spans") > 0
    out = scan(docs, text_col).withColumn("made", F.when(~hit, text).when(F.contains(text, F.lit(HIDDEN)), by_place).otherwise(plain))
    instead = {text_col: F.col("made")}
    if "n_chars" in docs.columns:
        instead["n_chars"] = F.when(hit, F.length("made")).otherwise(F.col("row.n_chars"))
    return out.select(*unwrapped(docs, **instead))
