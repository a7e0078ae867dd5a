"""Projections, filters and reports over a classified ledger."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerloom import fixed_values as V
from ledgerloom.functions import text as X
from ledgerloom.storage import materialize

ROW_ORDER = ("date", "txn_id")


# --- derived columns --------------------------------------------------------------
def with_signed(df: DataFrame) -> DataFrame:
    """``amount`` from the holder's point of view."""
    return df.withColumn("signed", F.when(F.col("account") == "checking", F.col("amount"))
                         .otherwise(-F.col("amount")).cast("decimal(18,2)"))


def with_match_text(df: DataFrame) -> DataFrame:
    return df.withColumn("match_text", X.match_text(F.col("descriptor"), F.col("description")))


def with_balances(statements: DataFrame) -> DataFrame:
    """Opening and closing balance from whichever labels the layout prints."""
    def label(*keys: str) -> Column:
        return F.coalesce(*[F.try_element_at("summary", F.lit(k)) for k in keys])

    return statements.withColumns({
        "opening_balance": label("beginning_balance", "previous_balance"),
        "closing_balance": label("ending_balance", "new_balance")})


def account_label(account: Column, last4: Column) -> Column:
    return F.concat(account, F.lit(" ···"), last4)


def with_account_label(df: DataFrame) -> DataFrame:
    return df.withColumn("label", account_label(F.col("account"), F.col("account_last4")))


# --- filters ----------------------------------------------------------------------
def is_spend() -> Column:
    """Outgoing spending: not an excluded category, and a card or checking kind that spends."""
    card = (F.col("account") == "credit") & F.col("kind").isin(V.CREDIT_SPEND_KINDS)
    checking = (F.col("account") == "checking") & (F.col("kind") == "withdrawal")
    return ~F.col("category").isin(V.NON_SPEND_CATEGORIES) & (card | checking)


def is_inflow() -> Column:
    return (F.col("signed") > 0) & F.col("category").isin(V.INFLOW_CATEGORIES)


def spend_rows(df: DataFrame) -> DataFrame:
    return df.where(is_spend())


def inflow_rows(df: DataFrame) -> DataFrame:
    return df.where(is_inflow())


LEDGER_ORDER = ["date", "account", "source_file", "source_line"]


def spend_months(df: DataFrame) -> DataFrame:
    """The months present in spend: at most one row per calendar month.

    Written as a table: periods, windows and flags read it several times.
    """
    return materialize(spend_rows(df).select("month").distinct(), "months")


def active_months(df: DataFrame) -> DataFrame:
    """The months in which anything was spent or came in."""
    flows = spend_rows(df).select("month").union(inflow_rows(df).select("month"))
    return flows.distinct()


def rows_not_in(df: DataFrame, targets: DataFrame, key: str = "txn_id") -> DataFrame:
    """The rows of ``df`` that are no target, by row id; rows that merely look like one stay."""
    return df.join(targets.select(key), key, "left_anti")


def period_months(months: DataFrame, period="all") -> DataFrame:
    """The months a period selects: ``all``, a number of last months, ``"2001"`` or (start, end)."""
    if isinstance(period, tuple):
        start, end = period
        if start > end:
            return months
        return months.where(F.col("month").between(start[:7], end[:7]))
    if period == "all":
        return months
    if isinstance(period, str) and len(period) == 4:
        return months.where(F.col("month").startswith(period))
    newest = F.dense_rank().over(Window.orderBy(F.desc("month")))
    return months.withColumn("newest", newest).where(F.col("newest") <= int(period)).select("month").distinct()


def period_filter(df: DataFrame, months: DataFrame) -> DataFrame:
    """Rows of the selected months; the month list is bounded by the calendar.

    Over a ledger in folders by month the join prunes at run time: only folders of selected months are read.
    """
    return df.join(F.broadcast(months), "month", "left_semi")


def prior_window(months: DataFrame, selected: DataFrame) -> DataFrame:
    """As many months as selected, right before them; empty without enough history."""
    by_month = Window.orderBy("month")
    numbered = months.withColumn("no", F.row_number().over(by_month))
    bounds = numbered.join(F.broadcast(selected), "month", "left_semi").agg(
        F.min("no").alias("lo"), F.count(F.lit(1)).alias("len"))
    lo, length = bounds.select("lo").scalar(), bounds.select("len").scalar()
    return (numbered.withColumns({"lo": lo, "len": length})
            .where((F.col("lo") > F.col("len")) & F.col("no").between(F.col("lo") - F.col("len"), F.col("lo") - 1))
            .select("month"))


def search(df: DataFrame, query: str, limit: int = 600, text: str = "description") -> DataFrame:
    """Newest rows holding the text in merchant, category or raw description, and how many match."""
    needle = query.lower()
    hit = df.where(F.lower("merchant").contains(needle) | F.lower("category").contains(needle)
                   | F.lower(text).contains(needle))
    newest = hit.orderBy(*[F.desc(c) for c in ROW_ORDER]).limit(limit)
    return newest.withColumn("matched", hit.agg(F.count(F.lit(1))).scalar())


def with_partial_flag(months: DataFrame) -> DataFrame:
    """The first and the last month of spend are not full."""
    ends = months.agg(F.min("month").alias("lo"), F.max("month").alias("hi"))
    return months.withColumn("partial", (F.col("month") == ends.select("lo").scalar())
                             | (F.col("month") == ends.select("hi").scalar()))


# --- reports ------------------------------------------------------------------------
def month_rollup(df: DataFrame) -> DataFrame:
    """Sums per month, category, account kind, row kind and direction, written as a table.

    It has at most a few hundred rows per month whatever the ledger holds, and every report below
    that only sums can read it in place of the rows.  Reports of several parts start here, so the
    ledger is scanned once for all of them.
    """
    folded = df.groupBy("month", "category", "account", "kind", (F.col("signed") > 0).alias("arrives")).agg(
        F.sum("signed").alias("signed"), F.sum("amount").alias("amount"))
    return materialize(folded, "rollup")


def spent() -> Column:
    return -F.col("signed")



def spend_by_category(df: DataFrame) -> DataFrame:
    """Spend, share and rows per category, with a TOTAL line."""
    sums = spend_rows(df).rollup("category").agg(
        F.sum(spent()).alias("spend"), F.count(F.lit(1)).alias("row_count"),
        F.grouping("category").alias("is_total"))
    total = F.max(F.when(F.col("is_total") == 1, F.col("spend"))).over(Window.partitionBy(F.lit(0)))
    return sums.withColumn("share", F.try_divide(F.col("spend").cast("double"), total.cast("double"))).select(
        F.when(F.col("is_total") == 1, "TOTAL").otherwise(F.col("category")).alias("category"),
        "spend", "share", "row_count").orderBy(F.desc("spend"), "category")


def category_coverage(df: DataFrame) -> DataFrame:
    """How much of spend has a category; the share is null without spend."""
    open_row = F.col("category") == V.UNCATEGORIZED
    out = spend_rows(df).agg(
        F.coalesce(F.sum(spent()), F.lit(0)).alias("total"),
        F.coalesce(F.sum(F.when(open_row, spent())), F.lit(0)).alias("uncategorized"),
        F.count(F.lit(1)).alias("row_count"), F.count_if(open_row).alias("open_rows"))
    return out.withColumn("share", 1 - F.try_divide(F.col("uncategorized").cast("double"),
                                                    F.col("total").cast("double")))


def uncategorized_worklist(df: DataFrame, limit: int = 40) -> DataFrame:
    return (spend_rows(df).where(F.col("category") == V.UNCATEGORIZED).groupBy("merchant")
            .agg(F.count(F.lit(1)).alias("row_count"), F.sum(spent()).alias("spend"))
            .orderBy(F.desc("spend"), "merchant").limit(limit))


def uncategorized_enriched(df: DataFrame, order=ROW_ORDER) -> DataFrame:
    """Every open merchant with a sample, its first originator id, an advisory guess, the remainder."""
    rows = with_match_text(spend_rows(df).where(F.col("category") == V.UNCATEGORIZED)).withColumn(
        "originator", X.ach_originator(F.col("match_text")))
    position = F.struct(*order)
    groups = rows.groupBy("merchant").agg(
        F.count(F.lit(1)).alias("row_count"), F.sum(spent()).alias("spend"),
        F.min_by(F.substring("match_text", 1, 90), position).alias("sample"),
        F.min_by("originator", F.when(F.col("originator").isNotNull(), position)).alias("originator"))
    remaining = rows.agg(F.sum(spent())).scalar()
    return X.with_suggested_category(groups, "merchant", "guess").withColumn("remaining", remaining)


def ranked_categories(df: DataFrame) -> DataFrame:
    return spend_rows(df).groupBy("category").agg(F.sum(spent()).alias("spend")).orderBy(
        F.desc("spend"), "category")


def month_category_spend(df: DataFrame) -> DataFrame:
    return spend_rows(df).groupBy("month", "category").agg(F.sum(spent()).alias("spend"))


def zero_filled(cells: DataFrame, column: str, members: Column) -> DataFrame:
    """Every month with every member of an array, missing cells zero."""
    frame = cells.select("month").distinct().withColumn(column, F.explode(members))
    return frame.join(cells, ["month", column], "left").fillna(0, ["spend"])


def monthly_category_grid(df: DataFrame, top: int = 7) -> DataFrame:
    """Month x (top categories of the whole period, rest as Other), zero-filled."""
    df = month_rollup(df)
    cells = month_category_spend(df)
    best = ranked_categories(df).limit(top).agg(F.collect_list("category")).scalar()
    folded = (cells.withColumn("best", best)
              .withColumn("bucket", F.when(F.array_contains("best", F.col("category")), F.col("category"))
                          .otherwise(F.lit("Other")))
              .groupBy("month", "bucket").agg(F.sum("spend").alias("spend")))
    return zero_filled(folded, "bucket", F.array_append(best, F.lit("Other")))


def category_month_matrix(df: DataFrame) -> DataFrame:
    """Month x category in long form, zero-filled over all categories of spend."""
    df = month_rollup(df)
    cells = month_category_spend(df)
    members = cells.agg(F.collect_set("category")).scalar()
    return zero_filled(cells, "category", members)


def cashflow_monthly(df: DataFrame) -> DataFrame:
    """Money in by sort and money out per month; transfers are on neither side."""
    def arriving(*categories: str) -> Column:
        return F.coalesce(F.sum(F.when(is_inflow() & F.col("category").isin(*categories), F.col("signed"))), F.lit(0))

    return df.where(is_spend() | is_inflow()).groupBy("month").agg(
        arriving(*V.INFLOW_CATEGORIES).alias("money_in"), arriving(V.INCOME).alias("income"),
        arriving(V.REIMBURSEMENTS, V.REFUNDS).alias("reimbursed"), arriving(V.ONE_OFF).alias("one_off"),
        F.coalesce(F.sum(F.when(is_spend(), spent())), F.lit(0)).alias("money_out"))


def inflow_sources(df: DataFrame) -> DataFrame:
    return (inflow_rows(df).groupBy("merchant", "category")
            .agg(F.sum("signed").alias("total"), F.count(F.lit(1)).alias("row_count"))
            .orderBy(F.desc("total"), "merchant", "category"))


def period_inflow_sources(df: DataFrame, months: DataFrame, order=ROW_ORDER) -> DataFrame:
    """Sources of a period by merchant (category as first seen, newest first) and the income share."""
    rows = inflow_rows(period_filter(df, months))
    sources = rows.groupBy("merchant").agg(
        F.max_by("category", F.struct(*order)).alias("category"),
        F.sum("signed").alias("total"), F.count(F.lit(1)).alias("row_count"))
    sums = sources.agg(F.sum(F.when(F.col("category") == V.INCOME, F.col("total"))).alias("i"),
                       F.sum("total").alias("t"))
    return sources.withColumn("income_share", sums.select(
        F.try_divide(F.coalesce(F.col("i"), F.lit(0)).cast("double"), F.col("t").cast("double"))).scalar())


def transfers_net(df: DataFrame) -> DataFrame:
    return df.agg(F.coalesce(F.sum(F.when(F.col("category") == V.TRANSFERS, F.col("signed"))), F.lit(0))
                  .alias("transfers_net"))


def finance_charges_monthly(df: DataFrame) -> DataFrame:
    """Interest and fees on cards per month of spend, zero-filled, the peak month marked."""
    df = month_rollup(df)
    charges = (df.where((F.col("account") == "credit") & F.col("kind").isin("interest", "fee"))
               .groupBy("month").agg(F.sum("amount").alias("charges")))
    series = spend_months(df).join(charges, "month", "left").fillna(0, ["charges"])
    peak = series.agg(F.max_by("month", F.struct(F.col("charges"), -F.replace("month", F.lit("-"), F.lit("")).cast("int"))))
    return series.withColumn("peak", F.col("month") == peak.scalar())


def top_merchants(df: DataFrame, n: int = 15) -> DataFrame:
    return (spend_rows(df).groupBy("merchant")
            .agg(F.sum(spent()).alias("spend"), F.count(F.lit(1)).alias("row_count"))
            .orderBy(F.desc("spend"), "merchant").limit(n))


def coverage_stats(statements: DataFrame, df: DataFrame) -> DataFrame:
    return statements.agg(F.min("period_start").alias("start"), F.max("period_end").alias("end"),
                          F.count(F.lit(1)).alias("statements")).withColumn(
        "row_count", df.agg(F.count(F.lit(1))).scalar())


def category_totals_full(df: DataFrame) -> DataFrame:
    """Full-resolution totals above zero with their share of all spend."""
    totals = spend_rows(df).groupBy("category").agg(F.sum(spent()).alias("spend"))
    everything = F.sum("spend").over(Window.partitionBy(F.lit(0)))
    return (totals.withColumn("share", F.try_divide(F.col("spend").cast("double"), everything.cast("double")))
            .where(F.col("spend") > 0).orderBy(F.desc("spend"), "category"))


def balances_timeline(statements: DataFrame, key=("account", "account_last4")) -> DataFrame:
    """A point per statement with a closing balance, liabilities first, then by account and date."""
    return (with_balances(statements).where(F.col("closing_balance").isNotNull())
            .select(*key, "stmt_id", F.col("period_end").alias("date"), F.col("closing_balance").alias("balance"),
                    (F.col("account") != "credit").alias("asset"))
            .orderBy("asset", *key, "date", "stmt_id"))


def balance_edges(statements: DataFrame, key=("account", "account_last4"), months: DataFrame | None = None) -> DataFrame:
    """First and last point of every account's balance series in the period."""
    points = balances_timeline(statements, key).withColumn("month", X.month_key(F.col("date")))
    if months is not None:
        points = period_filter(points, months)
    at = F.struct("date", "stmt_id")
    return points.groupBy(*key).agg(
        F.min_by("balance", at).alias("first_balance"), F.max_by("balance", at).alias("last_balance"),
        F.min("date").alias("first_date"), F.max("date").alias("last_date"))


def books_close(df: DataFrame) -> DataFrame:
    """Money in minus spend plus transfers is the net movement of all rows that are one of these."""
    out = df.agg(
        F.coalesce(F.sum(F.when(is_inflow(), F.col("signed"))), F.lit(0)).alias("money_in"),
        F.coalesce(F.sum(F.when(is_spend(), spent())), F.lit(0)).alias("money_out"),
        F.coalesce(F.sum(F.when(F.col("category") == V.TRANSFERS, F.col("signed"))), F.lit(0)).alias("transfers"),
        F.sum("signed").alias("actual"))
    out = out.withColumn("expected", F.col("money_in") - F.col("money_out") + F.col("transfers"))
    return out.withColumn("ok", F.abs(F.col("expected") - F.col("actual")) <= F.lit(0.005))


def deficit_months(flow: DataFrame) -> DataFrame:
    return flow.agg(F.count(F.lit(1)).alias("months"),
                    F.count_if(F.col("money_in") < F.col("money_out")).alias("deficit_months"),
                    F.sum("money_in").alias("money_in"), F.sum("money_out").alias("money_out"),
                    (F.sum("money_in") - F.sum("money_out")).alias("net"))


def account_groups(statements: DataFrame, key=("account", "account_last4")) -> DataFrame:
    return statements.groupBy(*key).agg(F.count(F.lit(1)).alias("statements"))


def headline_kpis(df: DataFrame, statements: DataFrame, period="all", key=("account", "account_last4")) -> DataFrame:
    """One row of headline figures for a period."""
    df = month_rollup(df)
    all_months = spend_months(df)
    months = period_months(all_months, period)
    flags = with_partial_flag(all_months)
    flow = period_filter(cashflow_monthly(df), months).join(F.broadcast(flags), "month")
    full = ~F.col("partial")
    out = flow.agg(
        F.count(F.lit(1)).alias("months"), F.count_if(full).alias("full_months"),
        F.sum("money_in").alias("money_in"), F.sum("money_out").alias("spending"),
        (F.sum("money_in") - F.sum("money_out")).alias("net"), F.sum("income").alias("income"),
        F.coalesce(F.try_divide(F.sum(F.when(full, F.col("income"))).cast("double"), F.count_if(full).cast("double")),
                   F.lit(0.0)).alias("avg_income"),
        F.coalesce(F.try_divide(F.sum(F.when(full, F.col("money_out"))).cast("double"), F.count_if(full).cast("double")),
                   F.lit(0.0)).alias("avg_spend"))
    edges = balance_edges(statements.where("account = 'credit'"), key, months).agg(
        F.coalesce(F.sum("last_balance"), F.lit(0)).alias("card_now"),
        F.coalesce(F.sum("first_balance"), F.lit(0)).alias("card_then"))
    charges = period_filter(finance_charges_monthly(df), months).agg(F.sum("charges"))
    best = (spend_rows(period_filter(df, months)).groupBy("category").agg(F.sum(spent()).alias("s"))
            .orderBy(F.desc("s"), "category").limit(1))
    return out.withColumns({
        "card_now": edges.select("card_now").scalar(), "card_then": edges.select("card_then").scalar(),
        "finance_charges": charges.scalar(), "top_category": best.select("category").scalar(),
        "top_spend": best.select("s").scalar(),
    }).withColumn("top_share", F.try_divide(F.col("top_spend").cast("double"), F.col("spending").cast("double")))


def period_change(df: DataFrame, current: DataFrame, prior: DataFrame) -> DataFrame:
    """Current against prior spend per category over the union of categories (full outer join)."""
    def totals(months: DataFrame, name: str) -> DataFrame:
        return spend_rows(period_filter(df, months)).groupBy("category").agg(F.sum(spent()).alias(name))

    both = totals(current, "current_spend").join(totals(prior, "prior_spend"), "category", "full")
    return both.fillna(0, ["current_spend", "prior_spend"]).withColumn(
        "change", F.col("current_spend") - F.col("prior_spend"))


def ledger_order(df: DataFrame) -> DataFrame:
    """The total order of the ledger export."""
    return df.orderBy(*LEDGER_ORDER)


def report_order(statements: DataFrame) -> DataFrame:
    return statements.orderBy("account", "period_start", "stmt_id")
