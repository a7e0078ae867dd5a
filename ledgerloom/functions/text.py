"""Column functions over descriptors, money strings and dates.

Simple functions take and return a Column.  ``with_*`` functions add columns to a frame in stages,
so that an expression which is read several times is evaluated once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V

REGEX_META = set(".^$*+?()[]{}|\\")
BLANKS = " \t\n\x0b\f\r\x85\u2028\u2029"  # all that blanks and the end of a text may match in a pattern


# --- pattern helpers ------------------------------------------------------------
def split_alternatives(pattern: str) -> list[str]:
    """The top-level alternatives of a pattern."""
    parts, depth, in_class, current, i = [], 0, False, "", 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            current += pattern[i:i + 2]
            i += 2
            continue
        if in_class:
            in_class = ch != "]"
        elif ch == "[":
            in_class = True
        elif ch in "()":
            depth += 1 if ch == "(" else -1
        elif ch == "|" and depth == 0:
            parts.append(current)
            current, i = "", i + 1
            continue
        current += ch
        i += 1
    return parts + [current]


def literal_of(alternative: str) -> str | None:
    """The plain text an alternative stands for, or None when it needs a regex."""
    out, i = "", 0
    while i < len(alternative):
        ch = alternative[i]
        if ch == "\\":
            nxt = alternative[i + 1:i + 2]
            if not nxt or nxt.isalnum():
                return None
            out, i = out + nxt, i + 2
        elif ch in REGEX_META:
            return None
        else:
            out, i = out + ch, i + 1
    return out or None


def sql_literal(value: str | None) -> str:
    """A Spark SQL string literal."""
    if value is None:
        return "cast(null as string)"
    return "'" + value.replace("\\", "\\\\").replace("'", "\\'") + "'"


def matches_sql(column: str, pattern: str, flags: str = "") -> str:
    """SQL condition: ``column`` contains a match of ``pattern``.

    Literal alternatives become substring searches, which cost far less than a regex; only the
    rest is left to one ``rlike``.  With flags, everything is left to the regex.
    """
    plain, regex = [], []
    for alternative in [pattern] if flags else split_alternatives(pattern):
        literal = None if flags else literal_of(alternative)
        (regex.append(alternative) if literal is None else plain.append(literal))
    conditions = [f"contains({column}, {sql_literal(p)})" for p in plain]
    if regex:
        conditions.append(f"{column} rlike {sql_literal(flags + '|'.join(regex))}")
    return "(" + " or ".join(conditions) + ")"


def matches(column: str, pattern: str) -> Column:
    return F.expr(matches_sql(column, pattern))


def _certain_text(alternative: str) -> str | None:
    """The longest plain run of an alternative that each of its matches holds; None when none of two characters is certain."""
    runs, run, i = [], "", 0
    while i < len(alternative):
        ch = alternative[i]
        if ch == "\\":
            following = alternative[i + 1:i + 2]
            if following not in ("b", "d", "s") and (not following or following.isalnum()):
                return None
            if following in ("d", "s"):
                runs, run = [*runs, run], ""
            elif following != "b":
                run += following
            i += 2
            continue
        if ch == "?":  # what stands before it may be absent
            runs, run = [*runs, run[:-1]], ""
        elif ch in ".^$+":
            runs, run = [*runs, run], ""
        elif ch in "[]()*{}|":
            return None
        else:
            run += ch
        i += 1
    best = max([*runs, run], key=len)
    return best if len(best) > 1 else None


def _prefix_tree(texts: list[str]) -> str:
    """A pattern that finds any of ``texts``, which begin alike where they can: few branches are tried at a place."""
    heads: dict[str, list[str]] = {}
    for text in texts:
        heads.setdefault(text[0], []).append(text[1:])
    parts = []
    for head, tails in heads.items():
        mark = head if head.isalnum() or head == " " else "\\" + head
        parts.append(mark if "" in tails else mark + _prefix_tree(tails))
    return parts[0] if len(parts) == 1 else "(?:" + "|".join(parts) + ")"


def any_match_sql(column: str, pattern: str) -> str:
    """SQL condition: ``column`` contains a match of ``pattern``, as one search whose literal alternatives begin alike where they can.

    ``pattern`` has no flags and no references to groups.  Long chains of conditions make generated methods that are never compiled.
    """
    alternatives = split_alternatives(pattern)
    plain = {literal for a in alternatives if (literal := literal_of(a)) is not None}
    least = sorted(t for t in plain if not any(o != t and o in t for o in plain))
    parts = [*([_prefix_tree(least)] if least else []), *(a for a in alternatives if literal_of(a) is None)]
    return f"{column} rlike {sql_literal('|'.join(parts))}"


def may_match_sql(column: str, patterns: list[str], flags: str = "") -> str:
    """SQL condition that holds wherever one of ``patterns`` has a match, by one search instead of one for each; it may hold elsewhere.

    Each alternative is stood for by a text that it cannot match without, or by itself.  ``true`` where a pattern has
    syntax that cannot be put beside others.
    """
    texts, whole = set(), []
    for alternative in (a for p in patterns for a in split_alternatives(p)):
        text = _certain_text(alternative)
        if text is not None:
            texts.add(text)
        elif any(mark in alternative for mark in ("(?", "\\Q", "\\k", *(f"\\{n}" for n in range(10)))):
            return "true"
        else:
            whole.append(f"(?:{alternative})")
    least = sorted(t for t in texts if not any(o != t and o in t for o in texts))
    parts = [*([_prefix_tree(least)] if least else []), *whole]
    return f"{column} rlike {sql_literal(flags + '|'.join(parts))}" if parts else "true"


def first_group(text: Column, pattern: str, group: int = 1) -> Column:
    """A capture group of the first match, null when there is no match or it is empty."""
    return F.nullif(F.regexp_extract(text, pattern, group), F.lit(""))


def squeeze(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


# --- money and dates ------------------------------------------------------------
def parse_money(text: Column) -> Column:
    """Printed money to DECIMAL(18,2): sign before or after ``$``, commas, ``.18``, leading ``+``."""
    bare = F.regexp_replace(text, r"[,$ ]", "")
    magnitude = F.regexp_replace(bare, r"^[-+]+", "").try_cast("decimal(18,2)")
    return F.when(bare.startswith("-"), -magnitude).otherwise(magnitude).cast("decimal(18,2)")


def date_of(year: Column, month: Column, day: Column) -> Column:
    """A date, or null when the day does not exist in that month."""
    return F.try_to_date(F.format_string("%04d-%02d-%02d", year, month, day), "yyyy-MM-dd")


def resolve_year(month: Column, day: Column, start: Column, end: Column,
                 slack_days: int = 45) -> Column:
    """The date for a bare MM/DD that lies nearest the period, null beyond the slack."""
    def cost(d: Column) -> Column:
        return F.when(d < start, F.datediff(start, d)).when(d > end, F.datediff(d, end)).otherwise(0)

    month, day = month.try_cast("int"), day.try_cast("int")
    first, second = date_of(F.year(start), month, day), date_of(F.year(end), month, day)
    best = F.least(
        F.when(first.isNotNull(), F.struct(cost(first).alias("cost"), first.alias("d"))),
        F.when(second.isNotNull(), F.struct(cost(second).alias("cost"), second.alias("d"))),
    )
    return F.when(best["cost"] <= slack_days, best["d"])


def year_for(month: Column, day: Column, close: Column) -> Column:
    """A bare MM/DD at or before a closing date: a later month belongs to the year before."""
    month, day = month.try_cast("int"), day.try_cast("int")
    return date_of(F.year(close) - F.when(month > F.month(close), 1).otherwise(0), month, day)


def long_date(text: Column) -> Column:
    return F.try_to_date(text, "MMMM d, yyyy")


def short_date(text: Column) -> Column:
    """MM/DD/YY with two-digit years 69-99 in the twentieth century."""
    day = F.try_to_date(text, "MM/dd/yy")
    return F.when(F.year(day) >= 2069, F.add_months(day, -1200)).otherwise(day)


def month_key(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM")


def iso_date(day: Column) -> Column:
    return F.date_format(day, "yyyy-MM-dd")


def month_label(day: Column) -> Column:
    return F.date_format(day, "MMM yy")


# --- names ------------------------------------------------------------------------
def capitalized(word: Column) -> Column:
    return F.concat(F.upper(F.substring(word, 1, 1)), F.lower(F.substring(word, 2, 2 ** 30)))


def titlecase(text: Column) -> Column:
    """Title case by word; acronyms of up to three letters and mixed case stay as they are."""
    def one(word: Column) -> Column:
        upper = (word == F.upper(word)) & (word != F.lower(word))
        lower = (word == F.lower(word)) & (word != F.upper(word))
        return (F.when((F.length(word) <= 3) & upper, word)
                .when(upper | lower, capitalized(word))
                .otherwise(word))

    words = F.filter(F.split(text, r"\s+"), lambda w: w != "")
    return F.array_join(F.transform(words, one), " ")


def ach_originator(text: Column) -> Column:
    """The stable originator id of an ACH entry: company id first, else a typed id."""
    return F.coalesce(first_group(text, V.ACH_COMPANY_ID), first_group(text, V.ACH_TYPED_ID))


def strip_ach_tail(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, V.ACH_TAIL, ""))


def strip_channel_prefix(text: Column) -> Column:
    return F.regexp_replace(text, V.CHANNEL_PREFIX, "")


def strip_wrappers(text: Column) -> Column:
    """Channel prefix, date prefix and card suffix removed."""
    text = F.regexp_replace(strip_channel_prefix(text), V.DATE_PREFIX, "")
    return F.regexp_replace(text, V.CARD_SUFFIX, "")


def strip_codes(text: Column) -> Column:
    """Processor prefix, URL, phone, store number and long code removed, in that order."""
    text = F.regexp_replace(text, V.PROCESSOR_PREFIX, "")
    for pattern in (V.URL, V.PHONE, V.STORE_NUMBER, V.LONG_CODE):
        text = F.regexp_replace(text, pattern, " ")
    return squeeze(text)


def with_codes_stripped(df: DataFrame, column: str) -> DataFrame:
    """``strip_codes`` of a column in place, where a pattern is tried only on texts that hold a character it needs."""
    digits = f"{column}_digits"

    def stripped(pattern: str, condition: Column, by: str = " ") -> Column:
        return F.when(condition, F.regexp_replace(column, pattern, by)).otherwise(F.col(column))

    text = F.col(column)
    df = df.withColumn(column, stripped(V.PROCESSOR_PREFIX, text.contains("*"), ""))
    df = df.withColumn(column, stripped(V.URL, text.contains("."))).withColumn(digits, text.rlike("[0-9]"))
    df = df.withColumn(column, stripped(V.PHONE, F.col(digits)))
    df = df.withColumn(column, stripped(V.STORE_NUMBER, text.contains("#") | text.contains("*")))
    return df.withColumn(column, squeeze(stripped(V.LONG_CODE, F.col(digits)))).drop(digits)


def strip_envelope(text: Column) -> Column:
    """Bank channel wrapper removed: doubled name, channel with date, long trailing reference."""
    second = F.trim(F.regexp_extract(text, V.ENVELOPE_DOUBLED, 2))
    first = F.trim(F.regexp_extract(text, V.ENVELOPE_DOUBLED, 1))
    inner = F.when(second == "", text).when(second.rlike(r"^\d"), first).otherwise(second)
    inner = F.regexp_replace(inner, V.ENVELOPE_CHANNEL, "")
    return F.trim(F.regexp_replace(inner, V.ENVELOPE_REFERENCE, ""))


def match_text(descriptor: Column, description: Column) -> Column:
    return F.coalesce(F.nullif(descriptor, F.lit("")), description)


def in_list(values: list[str]) -> str:
    return "(" + ", ".join(sql_literal(v) for v in values) + ")"


def with_city_state_stripped(df: DataFrame, source: str, target: str) -> DataFrame:
    """Drop a trailing ``<CITY> <ST>``; a company suffix or a business word in front is kept."""
    city, head, words, last, count = (f"{target}_{part}" for part in ("city", "head", "words", "last", "count"))
    # the pattern ends in a state and blanks: where the end is no state it cannot match, and long texts are not searched
    ends = F.right(F.rtrim(F.col(source), F.lit(BLANKS)), F.lit(2)).isin(V.STATE_CODES)
    df = df.withColumns({
        city: F.when(ends, F.regexp_extract(source, V.CITY_STATE, 1)).otherwise(F.lit("")),
        head: F.when(ends, F.regexp_replace(source, V.CITY_STATE, "")).otherwise(F.col(source)),
    }).withColumn(words, F.split(city, " ")).withColumns({
        last: F.expr(f"trim(both '.' from upper(element_at({words}, -1)))"),
        count: F.size(words),
    })

    def tail_is_city(n: int) -> str:
        tail = f"slice({words}, greatest({count} - {n - 1}, 1), {n})"
        return f"replace(upper(array_join({tail}, ' ')), '.', '') in {in_list(V.MULTIWORD_CITIES)}"

    hinted = any_match_sql(last, "|".join(p for p, _ in V.NAME_HINTS))
    dropped = (f"case when {count} > 1 and {tail_is_city(3)} then least({count}, 3) "
               f"when {count} > 1 and {tail_is_city(2)} then 2 "
               f"when {last} in {in_list(V.COMPANY_SUFFIXES)} or {hinted} then 0 else 1 end")
    kept = f"array_join(slice({words}, 1, {count} - {dropped}), ' ')"
    return df.withColumn(target, F.expr(
        f"case when {city} = '' then {source} else rtrim({head} || ' ' || {kept}) end")
    ).drop(city, head, words, last, count)


def with_clean(df: DataFrame, source: str, target: str) -> DataFrame:
    """The name left after channel, processor, store, phone, URL, city and state are stripped."""
    base, flag, bare, name = (f"{target}_{part}" for part in ("base", "channel", "bare", "name"))
    df = df.withColumns({flag: F.col(source).rlike(V.CHANNEL_PREFIX), base: strip_wrappers(F.col(source))})
    df = with_codes_stripped(df, base)
    df = with_city_state_stripped(df, base, bare)
    kept = F.when(F.col(flag), F.col(base)).otherwise(F.col(bare))
    kept = F.regexp_replace(F.regexp_replace(kept, V.TRAILING_STATE, " "), r"\s+", " ")
    df = df.withColumn(name, F.trim(F.regexp_replace(kept, V.EDGE_PUNCTUATION, "")))
    return df.withColumn(target, F.expr(
        f"case when {name} = '' or upper({name}) in {in_list(V.STATE_CODES)} "
        f"then regexp_extract({source}, {sql_literal(V.DOMAIN_ROOT)}, 1) else {name} end")
    ).drop(base, flag, bare, name)


def hint_case(column: str, hints) -> Column:
    """The category of the first hint that fires, else null.

    As an array of what each hint says: one chain of a hundred conditions would be fused with the clean-up into a method too long to be compiled.
    """
    return F.get(F.array_compact(F.array(*[F.when(matches(column, pattern), F.lit(category)) for pattern, category in hints])), F.lit(0))


def processor_category(raw: Column) -> Column:
    branch = F
    for pattern, unless, category in V.PROCESSOR_HINTS:
        hit = raw.rlike(pattern)
        branch = branch.when(hit & ~raw.rlike(unless) if unless else hit, F.lit(category))
    return branch.otherwise(F.lit(None).cast("string"))


def with_category_hint(df: DataFrame, source: str, target: str) -> DataFrame:
    """Keyword category of the cleaned upper-cased name, else the processor's, else null."""
    raw, cleaned = f"{target}_raw", f"{target}_cleaned"
    df = with_clean(df.withColumn(raw, F.upper(source)), raw, cleaned)
    return df.withColumn(
        target, F.coalesce(hint_case(cleaned, V.NAME_HINTS), processor_category(F.col(raw)))
    ).drop(raw, cleaned)


def with_suggested_category(df: DataFrame, source: str, target: str) -> DataFrame:
    """A loose advisory guess; null when nothing fires.  Never used by classification."""
    raw, cleaned = f"{target}_raw", f"{target}_cleaned"
    df = with_clean(df.withColumn(raw, F.upper(source)), raw, cleaned)
    return df.withColumn(
        target, hint_case(cleaned, V.ADVISORY_HINTS)).drop(raw, cleaned)


def rail_counterparty(text: Column) -> Column:
    """Counterparty of a person-to-person payment; '' when blank, null when not such a payment."""
    raw = F.trim(F.upper(text))
    who = F.regexp_replace(F.regexp_extract(raw, V.RAIL_SENT, 1), V.RAIL_REFERENCE, "")
    return F.when(raw.rlike(V.RAIL_SENT), F.regexp_replace(who, r"^[ -]+|[ -]+$", ""))


def classify_kind(account: Column, amount: Column, text: Column, section: Column) -> Column:
    """Row kind from the sign for asset accounts; sign, section and words for a card."""
    card = (F.when(amount < 0, F.when(text.rlike(V.CARD_PAYMENT_WORDS), "payment").otherwise("credit"))
            .when(section.isNotNull(), section)
            .when(text.rlike(V.CARD_INTEREST_WORDS), "interest")
            .when(text.rlike(V.CARD_FEE_WORDS), "fee")
            .otherwise("purchase"))
    return F.when(account == "credit", card).otherwise(
        F.when(amount > 0, "deposit").otherwise("withdrawal"))
