"""Statement layouts as values: everything that detection, extraction and the checks know of a bank's print.

A new layout is a ``Layout`` value given to ``prove(..., layouts=[*SHIPPED, mine])``; no code is added for it.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from ledgerloom import fixed_values as V


@dataclass(frozen=True)
class Period:
    """Start and end in two groups of ``pattern``; or, with ``opens``, the end alone and month and day of the start."""
    pattern: str
    dates: str = "long"  # "long": March 01, 2025; "short": 03/01/25
    opens: str | None = None


@dataclass(frozen=True)
class Sections:
    """Header lines that open a section, and what closes it; a page may start anew."""
    names: dict[str, str]
    suffix: str = ""
    closed_by: tuple[str, ...] = ()
    per_page: bool = False


@dataclass(frozen=True)
class Rows:
    """How the rows of one part of a statement are printed.

    ``fields`` names the groups of ``pattern``: mm, dd, yy, description, amount, balance, number.
    ``shape``: ``single`` line; ``wrapped`` over lines with the amount at the end; ``continued`` by lines below the
    amount; or ``several`` on a line.  The part is the whole document, a ``table`` (header, end) or lies
    ``between`` two of the layout's anchors (by place).  ``year``: from the ``period``, before the ``close``, or
    ``printed``.  ``kind``: by ``sign``, by ``section`` (card wording), or a kind of its own.
    """
    pattern: str
    fields: tuple[str, ...]
    shape: str = "single"
    table: tuple[str, str] | None = None
    between: tuple[int, int] | None = None
    skip: str | None = None
    noise: str | None = None
    longest: int = V.SEC_MAX_CONTINUATION
    year: str = "period"
    kind: str = "sign"
    sign: int = 1
    label: str = ""  # before each description


@dataclass(frozen=True)
class RowSum:
    """Sum of row amounts: of some kinds, above or below zero, with or without a start of the description."""
    kinds: tuple[str, ...] = ()
    above: bool | None = None
    starts: str | None = None
    starts_not: str | None = None


@dataclass(frozen=True)
class Total:
    """Printed values plus row sums.  A missing printed value makes it null, or with ``some`` counts as zero unless all miss."""
    printed: tuple[str, ...] = ()
    rows: tuple[RowSum, ...] = ()
    sign: int = 1  # of the row sums
    some: bool = False


@dataclass(frozen=True)
class Check:
    name: str
    expected: Total
    actual: Total


@dataclass(frozen=True)
class Layout:
    name: str
    label: str
    account: str
    polarity: int
    required: tuple[str, ...]
    markers: tuple[str, ...]
    period: Period
    account_number: str
    summary: dict[str, str] = field(default_factory=dict)  # label: pattern of a line, the first line counts
    table_summary: dict[str, str] = field(default_factory=dict)  # the same, of lines inside the table or before its end
    balances: tuple[str, int] | None = None  # pattern and group: the first one opens, the last one closes
    running_text: dict[str, str] = field(default_factory=dict)  # label: pattern anywhere in the text
    sections: Sections | None = None
    anchors: tuple[str, ...] = ()
    rows: tuple[Rows, ...] = ()
    checks: tuple[Check, ...] = ()
    walks_balance: bool = False
    strips_envelope: bool = False

    def registered(self) -> tuple:
        """The entry of the detection registry."""
        return self.name, self.label, self.account, self.polarity, list(self.required), list(self.markers)


def printed(*keys: str, some: bool = False) -> Total:
    return Total(printed=keys, some=some)


def summed(*rows: RowSum, plus: tuple[str, ...] = (), sign: int = 1) -> Total:
    return Total(printed=plus, rows=rows, sign=sign)


NET, POSITIVE, NEGATIVE = RowSum(), RowSum(above=True), RowSum(above=False)
PAPER = RowSum(starts="Check ")
OTHER_WITHDRAWALS = RowSum(kinds=("withdrawal",), starts_not="Check ")
CLOSES = Check("ending_balance", printed("ending_balance"), summed(NET, plus=("beginning_balance",)))
_names = "|".join(V.SEC_SECTIONS)
_by_name = {entry[0]: entry for entry in V.LAYOUTS}


def _registered(name: str) -> dict:
    _, label, account, polarity, required, markers = _by_name[name]
    return {"name": name, "label": label, "account": account, "polarity": polarity,
            "required": tuple(required), "markers": tuple(markers)}


def of_kinds(*kinds: str) -> Total:
    return summed(RowSum(kinds=kinds))


RUNNING = Layout(
    **_registered("chase_checking"), period=Period(V.RUN_PERIOD), account_number=V.RUN_ACCOUNT, summary=V.RUN_SUMMARY,
    table_summary={"beginning_balance": V.RUN_BEGIN, "ending_balance": V.RUN_END},
    rows=(Rows(V.RUN_ROW, ("mm", "dd", "description", "amount", "balance"), "wrapped", table=(V.RUN_TABLE_HEADER, V.RUN_END),
               skip=V.RUN_BEGIN, noise=V.RUN_NOISE),),
    checks=(CLOSES, Check("deposits_total", printed("deposits"), summed(POSITIVE)),
            Check("withdrawals_total", printed(*V.RUN_WITHDRAWAL_KEYS, some=True), summed(NEGATIVE))),
    walks_balance=True)

CARD = Layout(
    **_registered("chase_credit"), period=Period(V.CARD_PERIOD, "short"), account_number=V.CARD_ACCOUNT, summary=V.CARD_SUMMARY,
    sections=Sections(V.CARD_SECTIONS, closed_by=(V.CARD_SECTION_STOP,), per_page=True),
    rows=(Rows(V.CARD_ROW, ("mm", "dd", "description", "amount"), kind="section"),),
    checks=(Check("purchases_total", printed("purchases"), of_kinds("purchase")),
            Check("payments_total", printed("payments_credits"), of_kinds("payment", "credit")),
            Check("cash_advances_total", printed("cash_advances"), of_kinds("cash_advance")),
            Check("fees_total", printed("fees_charged"), of_kinds("fee")),
            Check("interest_total", printed("interest_charged"), of_kinds("interest")),
            Check("new_balance", printed("new_balance"), summed(NET, plus=("previous_balance",))),
            Check("fees_page_agrees", printed("fees_charged"), printed("total_fees_line")),
            Check("interest_page_agrees", printed("interest_charged"), printed("total_interest_line"))))

SECTIONED = Layout(
    **_registered("boa_checking"), period=Period(V.SEC_PERIOD), account_number=V.SEC_ACCOUNT,
    summary={"beginning_balance": V.SEC_BEGIN, "ending_balance": V.SEC_END,
             **{key: rf"^{name}\s+({V.PLAIN_MONEY})$" for name, key in V.SEC_SECTIONS.items()},
             **{f"total_{key}": rf"(?i)^Total {name}\s+({V.PLAIN_MONEY})$" for name, key in V.SEC_SECTIONS.items()}},
    sections=Sections({name: name for name in V.SEC_SECTIONS}, suffix="(?: - continued)?", closed_by=(
        rf"(?i)^Total ({_names})\s+{V.PLAIN_MONEY}$", rf"^{V.SEC_BANNER}(?: - continued)?$", rf"^{V.SEC_CONTINUED}")),
    rows=(Rows(V.SEC_ROW, ("mm", "dd", "yy", "description", "amount"), "continued", noise=V.SEC_NOISE, year="printed",
               skip=rf"(?:{V.SEC_BEGIN})|(?:{V.SEC_END})|(?:^({_names})\s+{V.PLAIN_MONEY}$)"),),
    checks=(Check("deposits_total", printed("total_deposits"), summed(POSITIVE)),
            Check("subtractions_total", printed(*[f"total_{s}" for s in V.SEC_SECTIONS.values() if s != "deposits"], some=True),
                  summed(NEGATIVE)),
            *[Check(f"summary_agrees_{s}", printed(s), printed(f"total_{s}")) for s in V.SEC_SECTIONS.values()], CLOSES),
    strips_envelope=True)

ANCHORED = Layout(
    **_registered("wellsfargo_checking"), period=Period(V.ANC_DATE, opens=V.ANC_BALANCE), account_number=V.ANC_ACCOUNT,
    balances=(V.ANC_BALANCE, 3), running_text=V.ANC_TOTALS, anchors=tuple(V.ANC_ANCHORS),
    rows=(Rows(V.ANC_TRIPLE, ("number", "mm", "dd", "amount"), "several", between=(3, 4), year="close", kind="withdrawal", sign=-1,
               label="Check "),
          *[Rows(V.ANC_ROW, ("mm", "dd", "description", "amount"), "wrapped", between=part, skip=V.ANC_RULE_LINE, year="close",
                 noise=r"^(Deposits and interest|Other withdrawals|Date )", kind=kind, sign=sign)
            for part, kind, sign in (((1, 2), "deposit", 1), ((5, 6), "withdrawal", -1))]),
    checks=(Check("checks_total", printed("checks"), summed(PAPER, sign=-1)),
            Check("other_withdrawals_total", printed("other_withdrawals"), summed(OTHER_WITHDRAWALS, sign=-1)),
            Check("withdrawals_total", printed("withdrawals"), summed(PAPER, OTHER_WITHDRAWALS, sign=-1)),
            Check("deposits_total", printed("deposits"), of_kinds("deposit")), CLOSES))

SHIPPED = (RUNNING, CARD, SECTIONED, ANCHORED)
