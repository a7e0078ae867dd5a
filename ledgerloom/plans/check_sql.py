"""Building blocks of the SQL checks: the ledger view and classification written for DuckDB."""

from __future__ import annotations

from ledgerloom import fixed_values as V
from ledgerloom.plans import testview as T


def lit(value: str) -> str:
    return "'" + value.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(lit(v) for v in values) + ")"


def sub(text: str, pattern: str, by: str = "") -> str:
    return f"regexp_replace({text}, {lit(pattern)}, {lit(by)}, 'g')"


def grp(text: str, pattern: str, group: int = 1) -> str:
    return f"regexp_extract({text}, {lit(pattern)}, {group})"


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, {lit(pattern)})"


def squeeze(text: str) -> str:
    return f"trim({sub(text, chr(92) + 's+', ' ')})"


def titlecase(text: str) -> str:
    words = f"list_filter(regexp_split_to_array({text}, '\\s+'), lambda w: w <> '')"
    up, low = "(w = upper(w) and w <> lower(w))", "(w = lower(w) and w <> upper(w))"
    return (f"coalesce(array_to_string(list_transform({words}, lambda w: case when length(w) <= 3 and {up} then w "
            f"when {up} or {low} then upper(w[1:1]) || lower(w[2:]) else w end), ' '), '')")


def envelope(text: str) -> str:
    second, first = f"trim({grp(text, V.ENVELOPE_DOUBLED, 2)})", f"trim({grp(text, V.ENVELOPE_DOUBLED, 1)})"
    inner = f"case when {second} = '' then {text} when {has(second, '^[0-9]')} then {first} else {second} end"
    return f"trim({sub(sub(inner, V.ENVELOPE_CHANNEL), V.ENVELOPE_REFERENCE)})"


def originator(text: str) -> str:
    return f"coalesce(nullif({grp(text, V.ACH_COMPANY_ID)}, ''), nullif({grp(text, V.ACH_TYPED_ID)}, ''))"


def wrappers(text: str) -> str:
    return sub(sub(sub(text, V.CHANNEL_PREFIX), V.DATE_PREFIX), V.CARD_SUFFIX)


def codes(text: str) -> str:
    out = sub(text, V.PROCESSOR_PREFIX)
    for pattern in (V.URL, V.PHONE, V.STORE_NUMBER, V.LONG_CODE):
        out = sub(out, pattern, " ")
    return squeeze(out)


def case_of(text: str, pairs, flags: str = "") -> str:
    return "case " + " ".join(f"when {has(text, flags + p)} then {lit(c)}" for p, c in pairs) + " end"


def cleaned(source: str, column: str, target: str) -> str:
    """A CTE chain that adds ``target`` = the cleaned ``column`` to the CTE ``source``; ends in ``<target>_z``."""
    t = target
    keep = f"* exclude ({t}_ch, {t}_base, {t}_city, {t}_head, {t}_w, {t}_last, {t}_n)"
    tail = lambda n: (f"replace(upper(array_to_string({t}_w[greatest(len({t}_w) - {n - 1}, 1):len({t}_w)], ' ')), '.', '') "
                      f"in {in_list(V.MULTIWORD_CITIES)}")
    hint = " or ".join(has(f"{t}_last", p) for p, _ in V.NAME_HINTS)
    dropped = (f"case when len({t}_w) > 1 and {tail(3)} then least(len({t}_w), 3) when len({t}_w) > 1 and {tail(2)} then 2 "
               f"when {t}_last in {in_list(V.COMPANY_SUFFIXES)} or {hint} then 0 else 1 end")
    bare = (f"case when {t}_ch or {t}_city = '' then {t}_base else "
            f"rtrim({t}_head || ' ' || array_to_string({t}_w[1:len({t}_w) - {t}_n], ' ')) end")
    name = f"trim({sub(sub(sub(bare, V.TRAILING_STATE, ' '), chr(92) + 's+', ' '), V.EDGE_PUNCTUATION)})"
    return f"""
{t}_a as (select *, {has(column, V.CHANNEL_PREFIX)} as {t}_ch, {codes(wrappers(column))} as {t}_base from {source}),
{t}_b as (select *, {grp(f'{t}_base', V.CITY_STATE)} as {t}_city, {sub(f'{t}_base', V.CITY_STATE)} as {t}_head from {t}_a),
{t}_c as (select *, string_split({t}_city, ' ') as {t}_w from {t}_b),
{t}_d as (select *, trim(upper({t}_w[-1]), '.') as {t}_last from {t}_c),
{t}_e as (select *, {dropped} as {t}_n from {t}_d),
{t}_f as (select {keep}, {name} as {t}_name from {t}_e),
{t}_z as (select * exclude ({t}_name), case when {t}_name = '' or upper({t}_name) in {in_list(V.STATE_CODES)}
  then {grp(column, V.DOMAIN_ROOT)} else {t}_name end as {t} from {t}_f)"""


def hints(source: str, column: str, target: str) -> str:
    """A CTE chain adding the keyword category of ``column``; ends in ``<target>_h``."""
    t = target
    processor = "case " + " ".join(
        f"when {has(f'upper({column})', p)}" + (f" and not {has(f'upper({column})', u)}" if u else "") + f" then {lit(c)}"
        for p, u, c in V.PROCESSOR_HINTS) + " end"
    return (f"{t}_u as (select *, upper({column}) as {t}_up from {source}),"
            + cleaned(f"{t}_u", f"{t}_up", f"{t}_k") +
            f", {t}_h as (select * exclude ({t}_up, {t}_k), coalesce({case_of(f'{t}_k', V.NAME_HINTS)}, {processor}) as {t} from {t}_k_z)")


def rule_number(text: str, rules, flags: str = "") -> str:
    if not rules:
        return "cast(null as int)"
    return "case " + " ".join(f"when {has(text, flags + p)} then {i}" for i, (p, _, _) in enumerate(rules, 1)) + " end"


def pick(rules, index: int, number: str) -> str:
    return f"([{', '.join(lit(r[index]) for r in rules)}])[{number}]"


def classified(source: str, rules=T.USER_RULES) -> str:
    """CTE chain from ``source(text, account, kind)`` to ``outcome(text, account, kind, merchant, category)``."""
    who = (f"case when {has('trim(upper(rail_text))', V.RAIL_SENT)} then trim("
           + sub(grp("trim(upper(rail_text))", V.RAIL_SENT), V.RAIL_REFERENCE) + ", ' -') end")
    ach_key = "upper(trim(orig))"
    ach = lambda i: "case " + " ".join(f"when {ach_key} = {lit(r[0])} then {lit(r[i])}" for r in rules.ach) + " end"
    payee_m = " ".join(f"when starts_with(who, {lit(p.upper())}) then {lit(l + ' (')} || {titlecase('who')} || ')'"
                       for p, l, _ in rules.payees)
    payee_c = " ".join(f"when starts_with(who, {lit(p.upper())}) then {lit(c)}" for p, _, c in rules.payees)
    refund = lambda c: f"case when kind = 'credit' then 'Refunds' else {c} end"
    kinds = lambda i: " ".join(f"when kind = {lit(k)} then {lit(o[i])}" for k, o in V.KIND_OUTCOMES.items())
    pay = lambda i: f"when kind = 'payment' and account = 'credit' then {lit(V.CARD_PAYMENT_OUTCOME[i])}"
    return f"""
k0 as (select *, case when kind = 'deposit' then trim({sub('text', V.DATE_PREFIX)}) else text end as subject_text,
  trim({sub(wrappers('text'), V.TRAILING_STATE)}) as rail_text, {originator('text')} as orig from {source}),
k1 as (select *, upper(subject_text) as subject, trim({sub('subject_text', V.ACH_TAIL)}) as payee_text from k0),
k2 as (select *, {rule_number('subject', rules.merchants, '(?i)')} as un, {rule_number('subject', V.DESCRIPTOR_RULES)} as sn,
  {rule_number('subject', V.ARRIVAL_RULES, '(?i)')} as an, {who} as who, {ach(1)} as ach_m, {ach(2)} as ach_c,
  {has('upper(rail_text)', V.RAIL_RECEIVED)} as rail_in, {has('subject', V.RAIL_RECEIVED)} as arrival_in from k1),
{cleaned('k2', 'payee_text', 'cn')},
{hints('cn_z', 'text', 'hint')},
k3 as (select *, coalesce(nullif({titlecase('cn')}, ''), payee_text) as name,
  {pick(rules.merchants, 1, 'un')} as um, {pick(rules.merchants, 2, 'un')} as uc,
  {pick(V.DESCRIPTOR_RULES, 1, 'sn')} as sm, {pick(V.DESCRIPTOR_RULES, 2, 'sn')} as sc,
  {pick(V.ARRIVAL_RULES, 1, 'an')} as am, {pick(V.ARRIVAL_RULES, 2, 'an')} as ac from hint_h),
outcome as (select text, account, kind,
 case {kinds(0)} {pay(0)}
  when kind = 'deposit' then coalesce(um, case when arrival_in then {lit(V.RAIL_RECEIVED_MERCHANT)} end, am, ach_m, sm, name)
  when rail_in then {lit(V.RAIL_RECEIVED_MERCHANT)}
  when who = '' then {lit(V.RAIL_BLANK_MERCHANT)}
  when who is not null then case {payee_m} else 'To ' || {titlecase('who')} end
  else coalesce(ach_m, um, sm, name) end as merchant,
 case {kinds(1)} {pay(1)}
  when kind = 'deposit' then case when um is not null then uc when arrival_in then 'Reimbursements' when am is not null then ac
    when ach_m is not null then 'Income' when sm is not null then 'Reimbursements' else 'One-off deposits' end
  when rail_in then 'Income' when who = '' then 'People & Services'
  when who is not null then case {payee_c} else 'People & Services' end
  else {refund("coalesce(ach_c, uc, sc, hint, 'uncategorized')")} end as category from k3)"""


_COLUMNS = ",\n  ".join(f"{e} as {n}" for n, e in T.TRANSACTION_COLUMNS.items())
TX = f"""first_part as (select l_orderkey, min(l_partkey) as fp from lineitem group by l_orderkey),
tx0 as (select {_COLUMNS} from orders join customer on o_custkey = c_custkey left join first_part on l_orderkey = o_orderkey
  left join part on p_partkey = fp join nation on n_nationkey = c_nationkey join region on r_regionkey = n_regionkey),
tx as (select *, case when txn_id % 12 > 5 then {envelope('description')} else '' end as descriptor from tx0)"""
LEDGER = f"""{TX},
texts as (select distinct coalesce(nullif(descriptor, ''), description) as text, account, kind from tx),
{classified('texts')},
ledger as materialized (select tx.*, coalesce(nullif(descriptor, ''), description) as match_text, merchant, category
  from tx join outcome o on o.text = coalesce(nullif(descriptor, ''), description) and o.account = tx.account and o.kind = tx.kind)"""

_SUM = lambda c, n: f"cast(coalesce(sum(case when {c} then amount end), 0) as decimal(18,2)) as {n}"
_ZERO = ", ".join(f"cast(0 as decimal(18,2)) as {n}" for n in (
    "net", "positive", "negative", "paper_checks", "payments", "credits", "purchases_sum", "advances", "fees_sum", "interest_sum"))
_SUMMARY = ",\n  ".join(f"{e} as {n}" for n, e in T.SUMMARY_COLUMNS.items())
STATEMENTS = f"""fig0 as (
 select stmt_id, owner, account, account_last4, layout_name, quarter_no, period_start, period_end, source_file,
  {_SUM('true', 'net')}, {_SUM('amount > 0', 'positive')}, {_SUM('amount < 0', 'negative')},
  {_SUM("amount < 0 and description like 'Check %'", 'paper_checks')}, {_SUM("kind = 'payment'", 'payments')},
  {_SUM("kind = 'credit'", 'credits')}, {_SUM("kind = 'purchase'", 'purchases_sum')},
  {_SUM("kind = 'cash_advance'", 'advances')}, {_SUM("kind = 'fee'", 'fees_sum')},
  {_SUM("kind = 'interest'", 'interest_sum')}, count(*) as txn_count from tx group by all
 union all
 select cast(c_custkey as string) || '-7981', c_custkey, {T.TRANSACTION_COLUMNS['account']}, {T.TRANSACTION_COLUMNS['account_last4']},
  {T.LAYOUT}, 7981, date '1995-01-01', date '1995-03-31', 'stmt-' || cast(c_custkey as string) || '-7981.txt',
  {_ZERO}, 0 from customer where c_custkey not in (select o_custkey from orders)),
fig as (select fig0.*, cast(cast(c_acctbal as decimal(18,2)) + coalesce(sum(net) over (partition by owner order by quarter_no
  rows between unbounded preceding and 1 preceding), 0) as decimal(18,2)) as opening from fig0 join customer on c_custkey = owner),
stmts as materialized (select *, {_SUMMARY} from fig),
bal as (select *, coalesce(beginning_balance, previous_balance) as opening_balance,
  coalesce(ending_balance, new_balance) as closing_balance from stmts)"""

SPEND = ("category not in ('Transfers', 'Refunds', 'Income', 'Reimbursements', 'One-off deposits') and "
         "((account = 'credit' and kind in ('purchase', 'cash_advance', 'fee', 'interest')) or "
         "(account = 'checking' and kind = 'withdrawal'))")
INFLOW = "signed > 0 and category in ('Income', 'Reimbursements', 'One-off deposits', 'Refunds')"
SPENDS = f"spend as (select * from ledger where {SPEND}), inflow as (select * from ledger where {INFLOW})"
FLOW = f"""flow as (select month,
  coalesce(sum(case when {INFLOW} then signed end), 0) as money_in,
  coalesce(sum(case when {INFLOW} and category = 'Income' then signed end), 0) as income,
  coalesce(sum(case when {INFLOW} and category in ('Reimbursements', 'Refunds') then signed end), 0) as reimbursed,
  coalesce(sum(case when {INFLOW} and category = 'One-off deposits' then signed end), 0) as one_off,
  coalesce(sum(case when {SPEND} then -signed end), 0) as money_out
  from ledger where ({SPEND}) or ({INFLOW}) group by month)"""


def d(expression: str, name: str | None = None) -> str:
    return f"cast({expression} as double) as {name or expression}"


def s(expression: str, name: str | None = None) -> str:
    return f"cast({expression} as string) as {name or expression}"


def n(expression: str, name: str | None = None) -> str:
    return f"cast({expression} as bigint) as {name or expression}"


def on_ledger(body: str) -> str:
    return f"with {LEDGER}, {SPENDS} {body}"


def on_statements(body: str, ctes: str = "") -> str:
    return f"with {TX}, {STATEMENTS}{', ' + ctes if ctes else ''} {body}"


def on_all(body: str, ctes: str = "") -> str:
    return f"with {LEDGER}, {SPENDS}, {STATEMENTS}{', ' + ctes if ctes else ''} {body}"
