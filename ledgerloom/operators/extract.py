"""Statement lines to headers, summaries and transactions, as a layout value describes them.

The input is ``lines(stmt_id, page_no, line_no, text)``.  What a line means may depend on lines far
above it (the open section, the table it lies in) or on a few around it (a wrapped row, a period printed over
two lines).  Both are ordered scans cut into blocks of lines, so neither a long document nor a long page is one
task, and no value holds a page.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.functions import text as X
from ledgerloom.operators.layouts import SHIPPED, Layout, Rows, Sections
from ledgerloom.operators.scan import are_short, key_sizes, not_null, ordered_scan
from ledgerloom.storage import broadcast_if_small, dealt, dealt_rows, materialize

DOC, SEGMENT, ORDER = ["stmt_id"], ["line_block"], ["line_no"]
BLOCK_LINES = 512
LINES_BELOW = 2
RESET = "<reset>"
MONEY = "decimal(18,2)"

SPECS = {layout.name: layout for layout in SHIPPED}


def of_layout(lines: DataFrame, name: str) -> DataFrame:
    return lines.where(F.col("layout_name") == name)


def in_blocks(lines: DataFrame) -> DataFrame:
    """Lines with the block they lie in: the segments of all scans over a document or a page."""
    return lines.withColumn("line_block", F.floor(F.col("line_no") / BLOCK_LINES))


# --- headers ---------------------------------------------------------------------------
def line_windows(lines: DataFrame, below: int = LINES_BELOW, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Each line with the next ones of its page under it as ``around``: what a printed phrase can run over."""
    page = ["stmt_id", "page_no"]
    sizes = sizes or key_sizes(lines, DOC)
    if are_short(sizes):
        lines = lines.select(*page, "line_no", "text")
        inside = Window.partitionBy(*page).orderBy(*ORDER)
        under = [F.lead("text", n).over(inside) for n in range(1, below + 1)]
        return dealt_rows(lines, sizes[1], *DOC).withColumns({c: not_null(lines, c) for c in page + ORDER}).select(
            "stmt_id", "line_no", F.concat_ws("\n", "text", *under).alias("around"))
    lines = dealt(in_blocks(lines.select(*page, "line_no", "text")), *page, *SEGMENT)
    blocks = lines.groupBy(*page).agg(F.min("line_block").alias("first"), F.max("line_block").alias("last"))
    long = broadcast_if_small(materialize(blocks.where("first < last").select(*page), "long_pages"))
    # only a page of several blocks needs lines of the next one
    near = ordered_scan(lines.join(long, page, "left_semi"), page, SEGMENT, ORDER, following={"under": (F.col("text"), below)})
    inside = Window.partitionBy(*page, *SEGMENT).orderBy(*ORDER)
    under = [F.lead("text", n).over(inside) for n in range(1, below + 1)]
    short = lines.join(long, page, "left_anti").withColumns({c: not_null(lines, c) for c in page + SEGMENT})
    return short.select("stmt_id", "line_no", F.concat_ws("\n", "text", *under).alias("around")).unionByName(
        near.select("stmt_id", "line_no", F.array_join(F.concat(F.array("text"), "under"), "\n").alias("around")))


def first_of(value: Column) -> Column:
    """The value of the first line that has one.

    The windows that hold a phrase begin at the line it starts on or above it, in order, so the first window with
    a match has the first phrase of the text.
    """
    return F.min_by(value, F.when(value.isNotNull(), F.col("line_no")))


def header_fields(lines: DataFrame, layout: Layout, sizes: tuple[int, int] | None = None) -> DataFrame:
    """One row per statement: period_start, period_end, account_last4 and what is printed in running text (``running``)."""
    around, period = F.col("around"), layout.period
    fields = {"digits": X.first_group(around, layout.account_number), "p1": X.first_group(around, period.pattern)}
    if period.opens:
        fields |= {"p2": X.first_group(around, period.opens), "p3": X.first_group(around, period.opens, 2)}
    else:
        fields["p2"] = X.first_group(around, period.pattern, 2)
    running = {k: X.first_group(around, p) for k, p in layout.running_text.items()}
    # few lines print a field: the others are gone before anything is sorted or grouped by statement; one search a pattern tells
    patterns = [layout.account_number, period.pattern, period.opens, *layout.running_text.values(), (layout.balances or [None])[0]]
    prints = reduce(lambda a, b: a | b, [around.rlike(p) for p in patterns if p])
    fields, running = ({n: first_of(v) for n, v in part.items()} for part in (fields, running))
    if layout.balances:
        pattern, group = layout.balances
        found = F.regexp_extract_all(around, F.lit(pattern), F.lit(group))
        at = F.when(F.size(found) > 0, F.col("line_no"))
        running = {"beginning_balance": F.min_by(F.element_at(found, 1), at),
                   "ending_balance": F.max_by(F.element_at(found, -1), at), **running}
    hits = line_windows(lines, sizes=sizes).where(prints).groupBy("stmt_id").agg(*[c.alias(n) for n, c in fields.items()],
                                                                    *[c.alias(f"run_{n}") for n, c in running.items()])
    wide = lines.select("stmt_id").distinct().join(hits, "stmt_id", "left")
    to_date = X.short_date if period.dates == "short" else X.long_date
    start, end = to_date(F.col("p1")), to_date(F.col("p2"))
    if period.opens:
        start, end = X.year_for(F.col("p2"), F.col("p3"), start), start
    entries = [F.struct(F.lit(k).alias("key"), X.parse_money(F.col(f"run_{k}")).cast(MONEY).alias("value")) for k in running]
    none = F.array().cast(f"array<struct<key:string,value:{MONEY}>>")
    return wide.select(
        "stmt_id", start.alias("period_start"), end.alias("period_end"),
        F.coalesce(F.right(F.regexp_replace("digits", r"\D", ""), F.lit(4)), F.lit("????")).alias("account_last4"),
        (F.filter(F.array(*entries), lambda e: e["value"].isNotNull()) if entries else none).alias("running"))


def extract_period(lines: DataFrame, layout: Layout) -> DataFrame:
    """``(stmt_id, period_start, period_end)``; a document without a period gets nulls (an error)."""
    return header_fields(lines, layout).select("stmt_id", "period_start", "period_end")


def extract_account_last4(lines: DataFrame, layout: Layout) -> DataFrame:
    return header_fields(lines, layout).select("stmt_id", "account_last4")


def running_summary(headers: DataFrame) -> DataFrame:
    """Long form of what a layout prints in running text: (stmt_id, key, value)."""
    return headers.select("stmt_id", F.inline("running"))


def extract_summary(lines: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """``(stmt_id, key, value)``: per label the value of the first line that prints it."""
    def sql(expression: str) -> str:
        return "case " + " ".join(f"when text rlike {X.sql_literal(p)} then {expression.format(k=X.sql_literal(k), p=X.sql_literal(p))}"
                                  for k, p in patterns.items()) + " end"

    hits = lines.select("stmt_id", "line_no", F.expr(sql("{k}")).alias("key"),
                        F.expr(sql("regexp_extract(text, {p}, 1)")).alias("printed")).where(F.col("key").isNotNull())
    return hits.groupBy("stmt_id", "key").agg(X.parse_money(F.min_by("printed", "line_no")).alias("value"))


def layout_summary(lines: DataFrame, layout: Layout, headers: DataFrame, sizes: tuple[int, int] | None = None) -> DataFrame | None:
    """All printed values of a layout, long; None if it declares none."""
    parts = []
    if layout.summary:
        parts.append(extract_summary(lines, layout.summary))
    table = next((r.table for r in layout.rows if r.table), None)
    if layout.table_summary and table:
        counted = table_region(lines, table, sizes).where((F.col("table") == "in") | ~F.col("text").rlike(table[1]))
        parts.append(extract_summary(counted, layout.table_summary))
    if layout.running_text or layout.balances:
        parts.append(running_summary(headers))
    return reduce(DataFrame.unionByName, parts) if parts else None


def summary_map(long: DataFrame) -> DataFrame:
    """Long summary rows to one map per statement; the number of labels is fixed by the layout."""
    return long.groupBy("stmt_id").agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("summary"))


# --- state down the lines -------------------------------------------------------------------
def section_event(sections: Sections) -> Column:
    """What a line does to the current section: its name for a header, ``<reset>`` for a line that closes, else null."""
    text = F.col("text")
    header = F.regexp_extract(text, rf"^({'|'.join(sections.names)}){sections.suffix}$", 1)
    names = F.create_map(*[F.lit(x) for pair in sections.names.items() for x in pair])
    closes = reduce(lambda a, b: a | b, [text.rlike(p) for p in sections.closed_by], F.lit(False))
    return F.when(closes, RESET).when(header != "", F.try_element_at(names, header))


def assign_section(lines: DataFrame, sections: Sections = SPECS["boa_checking"].sections, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Each line with the section it lies in, null outside; carried over blocks, and over pages unless a page starts anew."""
    keys = ["stmt_id", "page_no"] if sections.per_page else DOC
    sizes = sizes or key_sizes(lines, DOC)
    blocks = in_blocks(lines) if are_short(sizes) else dealt(in_blocks(lines), *keys, *SEGMENT)
    out = ordered_scan(blocks, keys, SEGMENT, ORDER, last_seen={"section": section_event(sections)}, sizes=sizes)
    return out.withColumn("section", F.nullif(F.col("section"), F.lit(RESET)))


def section_labels(layout_lines: DataFrame, layout: Layout = SPECS["chase_credit"]) -> DataFrame:
    """(MM/DD, amount) to section, from lines in reading order; keys under two sections are dropped."""
    spec = next(r for r in layout.rows if r.kind == "section")
    placed = assign_section(layout_lines, layout.sections)
    rows = placed.where(F.col("section").isNotNull() & F.col("text").rlike(spec.pattern) & ~F.col("text").isin(list(layout.sections.names)))
    return rows.groupBy("stmt_id", F.substring("text", 1, 5).alias("mmdd"),
                        X.parse_money(F.regexp_extract("text", spec.pattern, spec.fields.index("amount") + 1)).alias("amount")).agg(
        F.min("section").alias("section"), F.max("section").alias("other")).where("section = other").drop("other")


def section_lookup(rows: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows with the section their (MM/DD, amount) was printed under, null when unknown or ambiguous."""
    return rows.join(labels, ["stmt_id", "mmdd", "amount"], "left")


def drop_noise(lines: DataFrame, noise: str) -> DataFrame:
    return lines.where(~F.col("text").rlike(noise))


def starts_row(text: Column) -> Column:
    head = F.substring(text, 1, 6)
    return ((F.length(head) - F.length(F.replace(head, F.lit("/"), F.lit(""))) == 1)
            & F.substring(text, 1, 2).rlike(r"^\d+$"))


def assemble_wrapped_rows(lines: DataFrame, row: str, noise: str | None, flush: Column, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Rows whose amount ends the last of several lines: ``(stmt_id, line_no, text, outcome)``.

    A row start opens a buffer, following lines join it, and the shortest prefix that matches
    ``row`` is a row with the number of its first line.  A start, a complete row or a flush line
    gives up an unfinished buffer; so does a seventh line.  Lines outside a buffer are noise or
    unparsed.  ``outcome`` is ``row`` or ``unparsed``.

    Six lines above and below decide about a line, so one scan lends blocks of long documents those of their neighbours, and each
    line then tells its outcome by itself: a start that of its whole buffer, other lines whether one holds them.
    """
    text, most = F.col("text"), V.MAX_WRAPPED_LINES
    role = (F.when(flush, "flush").when(text.rlike(row), "whole").when(starts_row(text), "start").otherwise("more"))
    df = in_blocks(lines.select(*DOC, *ORDER, "text", role.alias("role")))
    df = ordered_scan(df, DOC, SEGMENT, ORDER, preceding={"above": (F.col("role"), most)},
                      following={"below": (F.struct("line_no", "text", "role"), most)}, sizes=sizes or key_sizes(lines, DOC))
    opener = F.try_element_at(F.filter("above", lambda r: r != "more"), F.lit(-1))
    quiet = F.lit(False) if noise is None else text.rlike(noise)
    loose = (F.col("role") == "more") & ~F.coalesce(opener == "start", F.lit(False)) & ~quiet
    stop = F.coalesce(F.expr("get(filter(sequence(1, size(below)), i -> below[i - 1].role <> 'more'), 0)") - 1, F.size("below"))
    own = F.struct("line_no", "text")
    df = df.withColumn("parts", F.when(F.col("role") == "start", F.concat(F.array(own), F.transform(
        F.when(stop > 0, F.slice("below", F.lit(1), stop)).otherwise(F.slice("below", 1, 0)),
        lambda b: F.struct(b["line_no"].alias("line_no"), b["text"].alias("text"))))))
    df = df.withColumn("texts", F.transform("parts", lambda p: p["text"]))
    df = df.withColumn("taken", F.when(F.col("role") == "start", F.expr(
        f"get(filter(sequence(1, size(texts)), k -> array_join(slice(texts, 1, k), ' ') rlike {X.sql_literal(row)}), 0)")))

    def out(line: Column, value: Column, outcome: str) -> Column:
        return F.struct(line.alias("line_no"), value.alias("text"), F.lit(outcome).alias("outcome"))

    taken = F.col("taken")
    joined = out(F.col("line_no"), F.expr("array_join(slice(texts, 1, taken), ' ')"), "row")
    rest = F.filter(F.expr("slice(parts, taken + 1, size(parts))"), lambda p: F.lit(True) if noise is None else ~p["text"].rlike(noise))
    lost = lambda parts: F.transform(parts, lambda p: out(p["line_no"], p["text"], "unparsed"))
    found = (F.when(F.col("role") == "whole", F.array(out(F.col("line_no"), text, "row")))
             .when(loose, F.array(out(F.col("line_no"), text, "unparsed")))
             .when(taken.isNotNull(), F.concat(F.array(joined), lost(rest)))
             .when(F.col("role") == "start", lost(F.col("parts"))))
    return df.where(loose | F.col("role").isin("whole", "start")).select(*DOC, F.inline(found))


def append_continuations(lines: DataFrame, row: str, noise: str, reset: Column,
                         longest: int = V.SEC_MAX_CONTINUATION, sizes: tuple[int, int] | None = None) -> DataFrame:
    """Rows whose description runs on below the amount: ``(stmt_id, line_no, text, more, section, outcome)``.

    Short lines that are neither rows nor noise belong to the row above in the same section; long
    ones, and those without a row above, are unparsed.  ``lines`` carry ``section``.  Texts are joined inside
    a block of lines, then over blocks, so very many lines below one row are no single sort.
    """
    text = F.col("text")
    df = lines.withColumn("role", F.when(reset, "reset").when(F.col("section").isNull(), "outside")
                          .when(text.rlike(row), "row").when(text.rlike(noise), "noise")
                          .when(F.length(text) <= longest, "short").otherwise("long"))
    opens = F.col("role").isin("row", "reset")
    df = in_blocks(df).select(*DOC, *SEGMENT, *ORDER, "text", "section", "role")
    sizes = sizes or key_sizes(lines, DOC)
    df = materialize(ordered_scan(df, DOC, SEGMENT, ORDER, sums={"group_no": opens.cast("int")},
                                  last_seen={"opened_by": F.when(opens, F.col("role"))}, sizes=sizes), "sections")
    belongs = (F.col("role") == "short") & (F.col("opened_by") == "row")
    is_row = F.col("role") == "row"
    short = are_short(sizes)
    by_block = df.where(is_row | belongs).groupBy(*DOC, "group_no", *([] if short else SEGMENT)).agg(
        F.max(F.when(is_row, F.struct("line_no", "text", "section"))).alias("head"),
        F.expr("listagg(case when role = 'short' then text end, ' ') within group (order by line_no)").alias("part"))
    rows = by_block.withColumnRenamed("part", "more") if short else by_block.groupBy(*DOC, "group_no").agg(
        F.max("head").alias("head"), F.expr("listagg(part, ' ') within group (order by line_block)").alias("more"))
    rows = rows.select(*DOC, "head.line_no", "head.text", F.coalesce("more", F.lit("")).alias("more"), "head.section",
                       F.lit("row").alias("outcome"))
    rest = df.where((F.col("role") == "long") | ((F.col("role") == "short") & ~F.coalesce(belongs, F.lit(False)))).select(
        *DOC, "line_no", "text", F.lit("").alias("more"), "section", F.lit("unparsed").alias("outcome"))
    return rows.unionByName(rest)


def extract_multi(lines: DataFrame, pattern: str = V.ANC_TRIPLE) -> DataFrame:
    """Several (number, MM, DD, amount) on a line: one row each."""
    parts = [F.regexp_extract_all("text", F.lit(pattern), F.lit(g)).alias(n)
             for g, n in ((1, "number"), (2, "mm"), (3, "dd"), (4, "printed"))]
    zipped = lines.select("stmt_id", "line_no", *parts).select(
        "stmt_id", "line_no", F.posexplode(F.arrays_zip("number", "mm", "dd", "printed")).alias("pos", "t"))
    return zipped.select("stmt_id", "line_no", "pos", "t.number", "t.mm", "t.dd", X.parse_money(F.col("t.printed")).alias("amount"))


def find_anchors(lines: DataFrame, anchors: list[str] = V.ANC_ANCHORS) -> DataFrame:
    """Per statement the line of each anchor: the first with that prefix at or after the one before.

    Only lines that start with an anchor take part; a missing anchor leaves null and the next one
    is looked for from the start.
    """
    state = materialize(lines.select("stmt_id").distinct(), "anchors")
    prefix = " ".join(f"when startswith(text, {X.sql_literal(a)}) then true" for a in anchors)
    hits = materialize(lines.where(F.expr(f"case {prefix} else false end")).select("stmt_id", "line_no", "text"), "hits")
    previous = F.lit(0)
    for i, anchor in enumerate(anchors):
        # inner join first: its many-row side may be split when one document has most of the hits,
        # and the minimum is combined before rows meet; the short state is cut so it is read, not redone
        found = (hits.where(F.col("text").startswith(anchor)).join(state, "stmt_id")
                 .where(F.col("line_no") >= previous).groupBy("stmt_id").agg(F.min("line_no").alias(f"a{i}")))
        state = materialize(state.join(found, "stmt_id", "left"), "anchors")
        previous = F.coalesce(F.col(f"a{i}"), F.lit(0))
    return state


def slice_between(lines: DataFrame, anchors: DataFrame, start: str, end: str) -> DataFrame:
    """Lines from one anchor up to another; none when either is missing or out of order."""
    bounds = anchors.select("stmt_id", F.col(start).alias("lo"), F.col(end).alias("hi"))
    return lines.join(bounds, "stmt_id").where(
        (F.col("line_no") >= F.col("lo")) & (F.col("line_no") < F.col("hi"))).drop("lo", "hi")


def table_region(lines: DataFrame, table: tuple[str, str] = (V.RUN_TABLE_HEADER, V.RUN_END), sizes: tuple[int, int] | None = None) -> DataFrame:
    """Whether the lines above left the scan inside the table that (header, end) lines bound: ``table`` is in, out or null."""
    event = F.when(F.col("text").rlike(table[0]), "in").when(F.col("text").rlike(table[1]), "out")
    sizes = sizes or key_sizes(lines, DOC)
    blocks = in_blocks(lines) if are_short(sizes) else dealt(in_blocks(lines), *DOC, *SEGMENT)
    return ordered_scan(blocks, DOC, SEGMENT, ORDER, seen_before={"table": event}, sizes=sizes)


# --- whole layouts -------------------------------------------------------------------------------
ROW_COLUMNS = ["stmt_id", "source_line", "date", "description", "amount", "kind", "balance", "outcome", "text"]


def with_fields(df: DataFrame, pattern: str, fields: tuple[str, ...]) -> tuple[DataFrame, dict[str, Column]]:
    """All capture groups of ``text`` from one regex pass; null where the text does not match."""
    mark = "\x01"
    df = df.withColumn("parts", F.split(F.regexp_replace("text", pattern, mark.join(f"${g}" for g in range(1, len(fields) + 1))), mark))
    return df, {n: F.get("parts", F.lit(g)) if g else F.when(F.size("parts") > 1, F.get("parts", F.lit(0)))
                for g, n in enumerate(fields)}


def _part(lines: DataFrame, layout: Layout, spec: Rows, anchors: DataFrame | None, sizes: tuple[int, int]) -> DataFrame:
    """The lines that ``spec`` reads, with ``section`` where the layout has sections of rows.

    Scans over short documents share a shuffle, so nothing is written between them.
    """
    part, cut = lines, (lambda df, name: df) if are_short(sizes) else materialize
    if spec.table:
        inside = (F.col("table") == "in") | F.col("text").rlike(spec.table[0])
        part = cut(table_region(lines, spec.table, sizes).where(inside).drop("table"), "region")
    elif spec.between:
        part = slice_between(lines, anchors, f"a{spec.between[0]}", f"a{spec.between[1]}")
    if spec.shape == "continued":
        if layout.sections:
            part = assign_section(part, layout.sections, sizes)
        else:
            part = part.withColumn("section", F.lit(""))
    if spec.skip:
        part = part.where(~F.col("text").rlike(spec.skip))
    return cut(part, "placed") if spec.shape == "continued" else part


def parse_part(lines: DataFrame, layout: Layout, spec: Rows, periods: DataFrame, reading: DataFrame | None = None,
               anchors: DataFrame | None = None, sizes: tuple[int, int] | None = None) -> DataFrame:
    """One part of a layout as ``ROW_COLUMNS``; ``outcome`` is ``row`` or ``unparsed``, and a row without a date is unparsed."""
    sizes = sizes or key_sizes(lines, DOC)
    part = _part(lines, layout, spec, anchors, sizes)
    section = F.lit(None).cast("string")
    if spec.shape == "several":
        rows = extract_multi(part, spec.pattern).withColumns({"outcome": F.lit("row"), "text": F.lit("")})
        fields = {n: F.col(n) for n in ("number", "mm", "dd")}
        amount, description = F.col("amount"), F.col("number")
    else:
        if spec.shape == "wrapped":
            flush = reduce(lambda a, b: a | b, [F.col("text").rlike(p) for p in spec.table or ()], F.lit(False))
            rows = assemble_wrapped_rows(part, spec.pattern, spec.noise, flush, sizes)
        elif spec.shape == "continued":
            reset = section_event(layout.sections).isNotNull() if layout.sections else F.lit(False)
            rows = append_continuations(part, spec.pattern, spec.noise or "^$", reset, spec.longest, sizes)
        elif spec.shape == "single":
            rows = part.where(F.col("text").rlike(spec.pattern)).withColumn("outcome", F.lit("row"))
        else:
            raise ValueError(f"layout {layout.name!r}: unknown shape of rows {spec.shape!r}")
        rows, fields = with_fields(rows, spec.pattern, spec.fields)
        amount = X.parse_money(fields["amount"])
        description = F.concat_ws(" ", fields["description"], F.col("more")) if spec.shape == "continued" else fields["description"]
        if spec.kind == "section" and reading is not None:
            rows = section_lookup(rows.withColumns({"mmdd": F.substring("text", 1, 5), "amount": amount}), section_labels(reading, layout))
            amount, section = F.col("amount"), F.col("section")
    if spec.year == "printed":
        date = X.short_date(F.concat_ws("/", fields["mm"], fields["dd"], fields["yy"]))
    else:
        rows = rows.join(periods, "stmt_id")
        date = (X.resolve_year(fields["mm"], fields["dd"], F.col("period_start"), F.col("period_end")) if spec.year == "period"
                else X.year_for(fields["mm"], fields["dd"], F.col("period_end")))
    balance = X.parse_money(fields["balance"]) if "balance" in fields else F.lit(None).cast(MONEY)
    parsed = rows.withColumns({
        "source_line": F.col("line_no"), "date": date, "description": X.squeeze(F.concat(F.lit(spec.label), description)),
        "amount": (amount * spec.sign).cast(MONEY), "balance": balance})
    kind = F.lit(spec.kind)
    if spec.kind in ("sign", "section"):
        kind = X.classify_kind(F.lit("credit" if spec.kind == "section" else "checking"), F.col("amount"), F.col("description"), section)
    outcome = F.when((F.col("outcome") == "row") & F.col("date").isNull(), "unparsed").otherwise(F.col("outcome"))
    return parsed.withColumns({"kind": kind, "outcome": outcome}).select(*ROW_COLUMNS)


def parse_layout(lines: DataFrame, layout: Layout, periods: DataFrame, reading: DataFrame | None = None,
                 sizes: tuple[int, int] | None = None) -> DataFrame:
    """All rows and unparsed lines of the statements of one layout.

    ``reading`` is the same text in reading order, for layouts whose rows take their kind from sections.  ``sizes`` are the
    ``key_sizes`` of the documents.
    """
    sizes = sizes or key_sizes(lines, DOC)
    anchors = find_anchors(lines, list(layout.anchors)) if layout.anchors else None
    return reduce(DataFrame.unionByName, [parse_part(lines, layout, spec, periods, reading, anchors, sizes) for spec in layout.rows])


def unparsed_report(parsed: DataFrame) -> DataFrame:
    """Everything inside a table or section that no rule consumed."""
    return parsed.where("outcome = 'unparsed'").select("stmt_id", F.col("source_line").alias("line_no"), "text")
