"""The queries in DuckDB's SQL."""

from __future__ import annotations

LEDGER = """ledger AS (
  SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderdate AS date, o_orderpriority AS description, CAST(o_orderkey AS VARCHAR) AS reference,
    CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS amount FROM orders)"""
EVENTS = """events_ledger AS (
  SELECT event_id AS row_id, ts AS date, event_type AS description, CASE WHEN event_id % 3 = 0 THEN -value ELSE value END AS amount FROM events)"""


def _key(day: str, description: str, amount: str) -> str:
    return f"'R-' || substr(sha256({day} || '|' || lower(trim({description})) || '|' || printf('%.2f', {amount})), 1, 16)"


ISO, COMPACT = "strftime(date, '%Y-%m-%d')", "strftime(date, '%Y%m%d')"
BATCH = f"""{EVENTS}, batch AS (
  SELECT row_id, date, description, CASE WHEN amount < 0 THEN -5.0 ELSE 5.0 END AS amount, day(date) AS d FROM events_ledger),
keyed AS (SELECT *, CASE WHEN amount >= 0 THEN 'Deposit' ELSE 'Purchase' END AS txn_type, {_key(ISO, "description", "amount")} AS doc_number FROM batch),
posted AS (SELECT txn_type, doc_number, CAST(min(row_id) AS VARCHAR) AS id FROM keyed WHERE d < 15 GROUP BY ALL),
plan AS (SELECT row_id, {ISO} AS date, description, CAST(amount AS DOUBLE) AS amount,
    CASE WHEN id IS NOT NULL OR row_number() OVER (PARTITION BY txn_type, doc_number ORDER BY row_id) > 1 THEN 'skipped_duplicate' ELSE 'created' END AS status,
    id AS posted_id, txn_type, doc_number FROM keyed LEFT JOIN posted USING (txn_type, doc_number))"""
TOTAL = "CAST(coalesce(sum(CAST({} AS DECIMAL(18, 2))), 0) AS DOUBLE)"

WORDS = """l AS (
  SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice, l_discount, l_tax, l_shipdate) AS n, l_returnflag = 'N' AS is_in FROM lineitem),
o AS (SELECT l_orderkey, count(*) AS n, sum(CASE WHEN is_in AND n % 3 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18, 2)) ELSE 0 END) AS credit,
    sum(CASE WHEN NOT is_in AND n % 3 <> 0 THEN CAST(l_extendedprice AS DECIMAL(18, 2)) ELSE 0 END) AS debit FROM l GROUP BY ALL),
raw AS (
  SELECT l_orderkey, 100.25 + 10 * n AS top, 61.5 AS x0, month(l_shipdate) || '/' || day(l_shipdate) AS text FROM l WHERE n % 3 <> 0
  UNION ALL SELECT l_orderkey, 100.25 + 10 * n, 120, CAST(l_suppkey AS VARCHAR) FROM l WHERE n % 3 <> 0 AND l_linenumber % 2 = 0
  UNION ALL SELECT l_orderkey, 100.25 + 10 * n, 150, 'Part' FROM l WHERE n % 3 <> 0
  UNION ALL SELECT l_orderkey, 100.25 + 10 * n, 190, CAST(l_partkey AS VARCHAR) FROM l WHERE n % 3 <> 0
  UNION ALL SELECT l_orderkey, 100.25 + 10 * n, CASE WHEN is_in THEN 405 ELSE 470 END, printf('%.2f', l_extendedprice) FROM l WHERE n % 3 <> 0
  UNION ALL SELECT l_orderkey, 100.25 + 10 * n, 533, '9.00' FROM l WHERE n % 3 <> 0
  UNION ALL SELECT l_orderkey, 100.25 + 10 * n, 150, 'Supplier' FROM l WHERE n % 3 = 0
  UNION ALL SELECT l_orderkey, 100.25 + 10 * n, 200, CAST(l_suppkey AS VARCHAR) FROM l WHERE n % 3 = 0
  UNION ALL SELECT l_orderkey, 100.25 + 10 * n, 395, 'x' FROM l WHERE n % 3 = 0
  UNION ALL SELECT l_orderkey, 50, x0, text FROM o, (VALUES (63, 'Date'), (117, 'Number'), (150, 'Description'), (413, 'Credits'), (483, 'Debits')) AS h(x0, text)
  UNION ALL SELECT l_orderkey, 100.0 + 10 * (n + 1), 61.5, 'Totals' FROM o
  UNION ALL SELECT l_orderkey, 100.0 + 10 * (n + 1), 400, '$' || printf('%.2f', CAST(credit + CASE WHEN l_orderkey % 7 = 0 THEN 1 ELSE 0 END AS DOUBLE)) FROM o
  UNION ALL SELECT l_orderkey, 100.0 + 10 * (n + 1), 465, '$' || printf('%.2f', CAST(debit AS DOUBLE)) FROM o),
words AS (SELECT 's' || l_orderkey AS source_file, CAST(round_even(CAST(top AS DOUBLE), 0) AS INTEGER) AS line, CAST(x0 AS DOUBLE) AS x0, text FROM raw),
lines AS (SELECT source_file, line, arg_min(text, x0) AS first, string_agg(text, ' ' ORDER BY x0) AS line_text FROM words GROUP BY ALL),
after_head AS (SELECT *, coalesce(max(CAST(first = 'Date' AND contains(line_text, 'Description') AS INT)) OVER (PARTITION BY source_file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM lines),
before_end AS (SELECT *, coalesce(max(CAST(first = 'Totals' AS INT)) OVER (PARTITION BY source_file ORDER BY line ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS over_ FROM after_head WHERE seen = 1),
segments AS (SELECT source_file, line, first, first = 'Totals' AS is_totals, regexp_matches(first, '^\\d{1,2}/\\d{1,2}$') AS opens,
    CAST(sum(CAST(regexp_matches(first, '^\\d{1,2}/\\d{1,2}$') AS INT)) OVER (PARTITION BY source_file ORDER BY line) AS BIGINT) AS ordinal FROM before_end WHERE over_ = 0),
rows_ AS (SELECT * FROM segments WHERE ordinal > 0 OR is_totals),
ranked AS (SELECT *, row_number() OVER (PARTITION BY source_file, line ORDER BY x0) AS k FROM words),
tokens AS (SELECT r.source_file, r.line, r.ordinal, r.is_totals, r.opens, r.first, w.x0, w.text,
    CASE WHEN x0 >= 110 AND x0 < 149 AND regexp_matches(text, '^\\d+$') THEN 'reference'
      WHEN regexp_matches(text, '^-?\\$?[\\d,]+\\.\\d{2}$') THEN CASE WHEN x0 >= 390 AND x0 < 460 THEN 'credit' WHEN x0 >= 460 AND x0 < 525 THEN 'debit' ELSE 'dropped' END
      WHEN x0 >= 390 THEN 'dropped' ELSE 'description' END AS class
  FROM rows_ r JOIN ranked w ON r.source_file = w.source_file AND r.line = w.line WHERE NOT ((r.opens OR r.is_totals) AND w.k = 1)),
tables AS (SELECT source_file, ordinal, is_totals, max(CASE WHEN opens THEN first END) AS day,
    coalesce(arg_max(text, line * 1000 + x0) FILTER (class = 'reference'), '') AS reference,
    CAST(replace(replace(arg_max(text, line * 1000 + x0) FILTER (class = 'credit'), '$', ''), ',', '') AS DOUBLE) AS credit,
    CAST(replace(replace(arg_max(text, line * 1000 + x0) FILTER (class = 'debit'), '$', ''), ',', '') AS DOUBLE) AS debit,
    coalesce(string_agg(text, ' ' ORDER BY line, x0) FILTER (class = 'description'), '') AS description FROM tokens GROUP BY ALL),
statement AS (SELECT source_file, row_number() OVER (PARTITION BY source_file ORDER BY ordinal) - 1 AS row_id,
    printf('%04d-%02d-%02d', CASE WHEN CAST(split_part(day, '/', 1) AS INT) > 6 THEN 1994 ELSE 1995 END, CAST(split_part(day, '/', 1) AS INT), CAST(split_part(day, '/', 2) AS INT)) AS day_text,
    description, reference, round(coalesce(credit, 0) - coalesce(debit, 0), 2) AS amount FROM tables WHERE NOT is_totals)"""

BLOCK = f"""{LEDGER}, keyed AS (SELECT *, {_key(COMPACT, "description", "amount")} AS base FROM ledger),
fit AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY row_id) AS k FROM keyed),
blocks AS (SELECT row_id, date, amount, concat_ws(chr(13) || chr(10), '<STMTTRN>', '<TRNTYPE>' || CASE WHEN amount >= 0 THEN 'CREDIT' ELSE 'DEBIT' END, '<DTPOSTED>' || {COMPACT},
    '<TRNAMT>' || printf('%.2f', amount), '<FITID>' || base || CASE WHEN k > 1 THEN '-' || k ELSE '' END, '<NAME>' || substr(description, 1, 32), '<MEMO>' || substr(description, 1, 255), '</STMTTRN>') AS block FROM fit)"""
_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
_SANITIZED = "trim(regexp_replace(regexp_replace(text, '[<>&\\r\\n\\t]', ' ', 'g'), '[ \\t\\n\\x0B\\f\\r]+', ' ', 'g'))"
_SUMMARY = f"count(*) AS entry_count, {TOTAL.format('amount')} AS total, strftime(min(date), '%Y-%m-%d') AS start_date, strftime(max(date), '%Y-%m-%d') AS end_date"

SQL = {
    "ledger_summary": f"WITH {LEDGER} SELECT {_SUMMARY} FROM ledger",
    "summary_by_description": f"WITH {LEDGER} SELECT description, {_SUMMARY} FROM ledger GROUP BY description",
    "ledger_entries": f"WITH {LEDGER} SELECT row_id, {ISO} AS date, description, reference, round(amount, 2) AS amount FROM ledger",
    "row_numbers": f"WITH {LEDGER} SELECT row_id, CAST(reference AS BIGINT) AS o_orderkey FROM ledger",
    "dated_balance": f"WITH {LEDGER} SELECT {TOTAL.format('amount')} AS balance, strftime(min(date), '%Y%m%d') AS dtstart, strftime(max(date), '%Y%m%d') AS dtend FROM ledger WHERE date IS NOT NULL",
    "sign_totals": f"""WITH {LEDGER} SELECT {TOTAL.format('CASE WHEN amount > 0 THEN amount END')} AS credits, {TOTAL.format('CASE WHEN amount < 0 THEN -amount END')} AS debits,
  count(*) FILTER (amount >= 0) AS credit_rows, count(*) FILTER (amount < 0) AS debit_rows FROM ledger""",
    "amount_parse": r"""WITH w AS (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN '$(' || printf('%.2f', abs(c_acctbal)) || ')' WHEN c_custkey % 3 = 0 THEN '$' || format('{:,.2f}', c_acctbal) || ' '
    WHEN c_custkey % 3 = 1 THEN '(' || printf('%.2f', abs(c_acctbal)) || ') ' ELSE printf('%.2f', c_acctbal) END AS written FROM customer)
SELECT c_custkey, written, TRY_CAST(trim(regexp_replace(regexp_replace(written, '[,$]', '', 'g'), '^\((.*)\)$', '-\1')) AS DOUBLE) AS amount FROM w""",
    "debit_credit_net": """SELECT o_orderkey, CASE o_orderstatus WHEN 'F' THEN o_totalprice ELSE 0.0 - abs(-o_totalprice) END AS amount FROM orders WHERE o_orderstatus IN ('F', 'O')""",
    "push_key": f"WITH {EVENTS} SELECT row_id, {_key(ISO, 'description', 'amount')} AS doc_number FROM events_ledger",
    "export_key": f"""WITH {EVENTS}, d AS (SELECT row_id, date, amount, CASE WHEN row_id % 5 = 0 THEN 'Transaction' ELSE description END AS description FROM events_ledger)
SELECT row_id, {_key(COMPACT, 'description', 'amount')} AS base_fitid FROM d""",
    "fitid_occurrence": f"""WITH {EVENTS}, k AS (SELECT row_id, {_key(COMPACT, 'description', '10.0')} AS base_fitid FROM events_ledger),
n AS (SELECT *, row_number() OVER (PARTITION BY base_fitid ORDER BY row_id) AS k FROM k) SELECT row_id, base_fitid, base_fitid || CASE WHEN k > 1 THEN '-' || k ELSE '' END AS fitid FROM n""",
    "text_clean": f"SELECT doc_id, trim(coalesce(text, ''), {_SPACE}) AS clean FROM documents",
    "sgml_sanitize": f"SELECT doc_id, substr({_SANITIZED}, 1, 32) AS name, substr({_SANITIZED}, 1, 255) AS memo FROM documents",
    "default_text": "SELECT p_partkey, CASE WHEN p_size < 10 OR p_name = '' THEN 'Transaction' ELSE p_name END AS description FROM part",
    "fixed_decimals": r"""SELECT s_suppkey, CASE WHEN s_suppkey % 4 = 0 THEN '-0.00' ELSE printf('%.2f', s_acctbal) END AS fixed,
  regexp_replace(CAST(CAST(s_acctbal AS DECIMAL(20, 2)) AS VARCHAR), '\.?0+$', '') AS short, format('{:,.2f}', s_acctbal) AS grouped FROM supplier""",
    "year_resolve": "SELECT o_orderkey, printf('%04d-%02d-%02d', CASE WHEN month(o_orderdate) > 2 THEN 1994 ELSE 1995 END, month(o_orderdate), least(day(o_orderdate), 28)) AS day FROM orders",
    "date_parse": "SELECT o_orderkey, CASE WHEN o_orderkey % 13 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders",
    "posting_plan": f"WITH {BATCH} SELECT * FROM plan",
    "to_create": f"WITH {BATCH} SELECT row_id, txn_type, doc_number FROM keyed ANTI JOIN posted USING (txn_type, doc_number)",
    "status_counts": f"WITH {BATCH} SELECT count(*) FILTER (status = 'created') AS created, count(*) FILTER (status = 'skipped_duplicate') AS skipped_duplicate, count(*) FILTER (status = 'error') AS errors FROM plan",
    "deposit_docs": f"""WITH {LEDGER} SELECT row_id, {ISO} AS "TxnDate", {_key(ISO, 'description', 'amount')} AS "DocNumber", description AS "PrivateNote", '35' AS bank, round(amount, 2) AS "Amount",
  'DepositLineDetail' AS "DetailType", '90' AS income FROM ledger WHERE amount >= 0""",
    "purchase_docs": f"""WITH {LEDGER} SELECT row_id, {ISO} AS "TxnDate", {_key(ISO, 'description', 'amount')} AS "DocNumber", description AS "PrivateNote", 'Cash' AS "PaymentType", '35' AS bank,
  abs(round(amount, 2)) AS "Amount", '70' AS expense FROM ledger WHERE amount < 0""",
    "type_routing": f"WITH {LEDGER} SELECT CASE WHEN amount >= 0 THEN 'Deposit' ELSE 'Purchase' END AS txn_type, count(*) AS documents FROM ledger GROUP BY ALL",
    "active_accounts": "SELECT CAST(s_suppkey AS VARCHAR) AS id, s_name AS name, 'Bank' AS account_type, CAST(NULL AS VARCHAR) AS account_sub_type FROM supplier WHERE s_acctbal > 0",
    "ofx_blocks": f"WITH {BLOCK} SELECT row_id, block FROM blocks",
    "ofx_documents": f"""WITH keyed AS (SELECT o_custkey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row_id, o_orderdate AS date, o_orderpriority AS description,
    CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END AS amount, {_key(COMPACT, "o_orderpriority", "CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END").replace("strftime(date", "strftime(o_orderdate")} AS base FROM orders),
fit AS (SELECT *, row_number() OVER (PARTITION BY o_custkey, base ORDER BY row_id) AS k FROM keyed),
b AS (SELECT o_custkey, row_id, date, amount, concat_ws(chr(13) || chr(10), '<STMTTRN>', '<TRNTYPE>' || CASE WHEN amount >= 0 THEN 'CREDIT' ELSE 'DEBIT' END, '<DTPOSTED>' || {COMPACT},
    '<TRNAMT>' || printf('%.2f', amount), '<FITID>' || base || CASE WHEN k > 1 THEN '-' || k ELSE '' END, '<NAME>' || substr(description, 1, 32), '<MEMO>' || substr(description, 1, 255), '</STMTTRN>') AS block FROM fit)
SELECT o_custkey, replace('OFXHEADER:100|DATA:OFXSGML|VERSION:102|SECURITY:NONE|ENCODING:USASCII|CHARSET:1252|COMPRESSION:NONE|OLDFILEUID:NONE|NEWFILEUID:NONE||<OFX>|<SIGNONMSGSRSV1>|<SONRS>|<STATUS>|<CODE>0|<SEVERITY>INFO|</STATUS>|<DTSERVER>20260101000000|<LANGUAGE>ENG|</SONRS>|</SIGNONMSGSRSV1>|<BANKMSGSRSV1>|<STMTTRNRS>|<TRNUID>1|<STATUS>|<CODE>0|<SEVERITY>INFO|</STATUS>|<STMTRS>|<CURDEF>USD|<BANKACCTFROM>|<BANKID>111000025|<ACCTID>' || o_custkey || '|<ACCTTYPE>CHECKING|</BANKACCTFROM>|<BANKTRANLIST>|<DTSTART>' || strftime(min(date), '%Y%m%d') || '|<DTEND>' || strftime(max(date), '%Y%m%d') || '|', '|', chr(13) || chr(10))
  || string_agg(block, chr(13) || chr(10) ORDER BY row_id)
  || replace('|</BANKTRANLIST>|<LEDGERBAL>|<BALAMT>' || printf('%.2f', {TOTAL.format('amount')}) || '|<DTASOF>' || strftime(max(date), '%Y%m%d') || '|</LEDGERBAL>|</STMTRS>|</STMTTRNRS>|</BANKMSGSRSV1>|</OFX>', '|', chr(13) || chr(10)) AS document
FROM b GROUP BY o_custkey""",
    "csv_lines": f"""WITH {LEDGER} SELECT row_id, '"' || {ISO} || '","' || description || '","' || reference || '","' || regexp_replace(CAST(CAST(amount AS DECIMAL(20, 2)) AS VARCHAR), '\\.?0+$', '') || '"' AS line FROM ledger""",
    "word_lines": f"WITH {WORDS} SELECT source_file, line, first, line_text FROM lines",
    "row_segments": f"WITH {WORDS} SELECT source_file, line, ordinal, is_totals FROM rows_",
    "token_class": f"WITH {WORDS} SELECT source_file, line, x0, text, class FROM tokens",
    "table_rows": f"WITH {WORDS} SELECT * FROM tables",
    "statement_ledger": f"WITH {WORDS} SELECT source_file, row_id, CASE WHEN day_text LIKE '%-02-29' THEN NULL ELSE day_text END AS day, description, reference, amount FROM statement",
    "reconcile": f"""WITH {WORDS}, declared AS (SELECT source_file, {TOTAL.format('coalesce(credit, 0)')} AS declared_credit, {TOTAL.format('coalesce(debit, 0)')} AS declared_debit FROM tables WHERE is_totals GROUP BY ALL),
parsed AS (SELECT source_file, {TOTAL.format('CASE WHEN amount > 0 THEN amount END')} AS parsed_credit, {TOTAL.format('CASE WHEN amount < 0 THEN -amount END')} AS parsed_debit FROM statement GROUP BY ALL)
SELECT source_file, declared_credit, declared_debit, coalesce(parsed_credit, 0.0) AS parsed_credit, coalesce(parsed_debit, 0.0) AS parsed_debit,
  abs(round(declared_credit - coalesce(parsed_credit, 0), 4)) <= 0.01 AND abs(round(declared_debit - coalesce(parsed_debit, 0), 4)) <= 0.01 AS agrees FROM declared LEFT JOIN parsed USING (source_file)""",
}

# two orders to a statement, a page each
_PAGED = f"""WITH {WORDS}, two AS (SELECT 'p' || CAST(floor(CAST(substr(source_file, 2) AS BIGINT) / 2) AS BIGINT) AS file, CAST(substr(source_file, 2) AS BIGINT) % 2 AS page, * FROM tables),
paged AS (SELECT file AS source_file, row_number() OVER (PARTITION BY file ORDER BY page, ordinal) - 1 AS row_id,
    printf('%04d-%02d-%02d', CASE WHEN CAST(split_part(day, '/', 1) AS INT) > 6 THEN 1994 ELSE 1995 END, CAST(split_part(day, '/', 1) AS INT), CAST(split_part(day, '/', 2) AS INT)) AS day_text,
    description, reference, round(coalesce(credit, 0) - coalesce(debit, 0), 2) AS amount FROM two WHERE NOT is_totals)"""
SQL |= {
    "paged_ledger": f"{_PAGED} SELECT source_file, row_id, CASE WHEN day_text LIKE '%-02-29' THEN NULL ELSE day_text END AS day, description, reference, amount FROM paged",
    "paged_totals": f"""{_PAGED}, declared AS (SELECT file AS source_file, {TOTAL.format('coalesce(credit, 0)')} AS declared_credit, {TOTAL.format('coalesce(debit, 0)')} AS declared_debit FROM two WHERE is_totals GROUP BY ALL),
parsed AS (SELECT source_file, {TOTAL.format('CASE WHEN amount > 0 THEN amount END')} AS parsed_credit, {TOTAL.format('CASE WHEN amount < 0 THEN -amount END')} AS parsed_debit FROM paged GROUP BY ALL)
SELECT source_file, declared_credit, declared_debit, coalesce(parsed_credit, 0.0) AS parsed_credit, coalesce(parsed_debit, 0.0) AS parsed_debit,
  abs(round(declared_credit - coalesce(parsed_credit, 0), 4)) <= 0.01 AND abs(round(declared_debit - coalesce(parsed_debit, 0), 4)) <= 0.01 AS agrees FROM declared LEFT JOIN parsed USING (source_file)""",
    "card_documents": SQL["ofx_documents"].replace("BANKMSGSRSV1", "CREDITCARDMSGSRSV1").replace("STMTTRNRS>", "CCSTMTTRNRS>").replace("STMTRS>", "CCSTMTRS>")
    .replace("<BANKACCTFROM>|<BANKID>111000025|", "<CCACCTFROM>|").replace("|<ACCTTYPE>CHECKING|</BANKACCTFROM>", "|</CCACCTFROM>"),
    "preview_entries": f"""WITH {LEDGER} SELECT {_SUMMARY}, count(*) AS entries,
  sha256(string_agg(concat_ws('|', row_id, strftime(date, '%Y-%m-%d'), description, reference, printf('%.2f', amount)), ';' ORDER BY row_id)) AS entries_sha256 FROM ledger""",
    "csv_intake": f"WITH {LEDGER} SELECT strftime(date, '%Y-%m-%d') AS day, description, reference, round(amount, 2) AS amount FROM ledger",
    "posting_outcomes": f"""WITH {BATCH}, looked AS (SELECT row_id, id, txn_type, doc_number, row_id % 50 = 7 AS missed,
    CASE WHEN row_id % 50 <> 7 THEN row_number() OVER (PARTITION BY txn_type, doc_number, row_id % 50 = 7 ORDER BY row_id) END AS turn FROM keyed LEFT JOIN posted USING (txn_type, doc_number)),
firsts AS (SELECT txn_type, doc_number, row_id AS f, CASE WHEN row_id % 3 <> 0 THEN 1 WHEN row_id % 2 <> 0 THEN 2 END AS good, CASE WHEN row_id % 3 = 0 THEN 2 ELSE 1 END AS last FROM looked WHERE id IS NULL AND turn = 1)
SELECT row_id, turn, CASE WHEN missed THEN 'error' WHEN id IS NOT NULL THEN 'skipped_duplicate' WHEN turn < coalesce(good, last + 1) THEN 'error' WHEN turn = coalesce(good, last + 1) THEN 'created' ELSE 'skipped_duplicate' END AS status,
  CASE WHEN missed THEN 'Could not be looked up: no answer for ' || row_id WHEN id IS NULL AND turn < coalesce(good, last + 1) THEN 'Could not be created: busy ' || turn
    WHEN id IS NULL AND turn = coalesce(good, last + 1) THEN '' ELSE 'Posted already: same date, description and amount.' END AS detail,
  CASE WHEN NOT missed THEN coalesce(id, CASE WHEN turn >= good THEN f || '-' || good END) END AS posted_id FROM looked LEFT JOIN firsts USING (txn_type, doc_number)""",
    "posting_creates": f"""WITH {BATCH}, looked AS (SELECT row_id, id, txn_type, doc_number, row_number() OVER (PARTITION BY txn_type, doc_number ORDER BY row_id) AS turn FROM keyed LEFT JOIN posted USING (txn_type, doc_number)),
goods AS (SELECT txn_type, doc_number, min(turn) AS good, arg_min(row_id, turn) AS made FROM looked WHERE id IS NULL AND row_id % 3 <> 0 GROUP BY ALL)
SELECT row_id, turn, CASE WHEN id IS NOT NULL THEN 'skipped_duplicate' WHEN good IS NULL OR turn < good THEN 'error' WHEN turn = good THEN 'created' ELSE 'skipped_duplicate' END AS status,
  CASE WHEN id IS NULL AND (good IS NULL OR turn < good) THEN 'Could not be created: row ' || row_id WHEN id IS NULL AND turn = good THEN '' ELSE 'Posted already: same date, description and amount.' END AS detail,
  coalesce(id, CASE WHEN turn >= good THEN made || '-1' END) AS posted_id FROM looked LEFT JOIN goods USING (txn_type, doc_number)""",
    "preview_pages": f"""WITH {LEDGER}, p AS (SELECT *, CAST(floor(row_id / 500) AS BIGINT) AS page FROM ledger)
SELECT page, min(row_id) AS first_row, max(row_id) AS last_row, CASE WHEN page < (SELECT max(page) FROM p) THEN 'after-' || max(row_id) END AS token,
  sha256('[' || string_agg('{{"row_id":' || row_id || ',"date":"' || {ISO} || '","description":"' || description || '","reference":"' || reference || '","amount":' || CAST(round(amount, 2) AS VARCHAR) || '}}', ',' ORDER BY row_id) || ']') AS entries_sha256 FROM p GROUP BY page""",
    "ofx_parts": f"""WITH {BLOCK}, ends AS (SELECT strftime(min(date), '%Y%m%d') AS low, strftime(max(date), '%Y%m%d') AS high, {TOTAL.format('amount')} AS balance, max(row_id) AS last FROM blocks),
pieces AS (SELECT -1 AS part, replace('OFXHEADER:100|DATA:OFXSGML|VERSION:102|SECURITY:NONE|ENCODING:USASCII|CHARSET:1252|COMPRESSION:NONE|OLDFILEUID:NONE|NEWFILEUID:NONE||<OFX>|<SIGNONMSGSRSV1>|<SONRS>|<STATUS>|<CODE>0|<SEVERITY>INFO|</STATUS>|<DTSERVER>20260101000000|<LANGUAGE>ENG|</SONRS>|</SIGNONMSGSRSV1>|<BANKMSGSRSV1>|<STMTTRNRS>|<TRNUID>1|<STATUS>|<CODE>0|<SEVERITY>INFO|</STATUS>|<STMTRS>|<CURDEF>USD|<BANKACCTFROM>|<BANKID>111000025|<ACCTID>123|<ACCTTYPE>CHECKING|</BANKACCTFROM>|<BANKTRANLIST>|<DTSTART>' || low || '|<DTEND>' || high, '|', chr(13) || chr(10)) AS text FROM ends
  UNION ALL SELECT row_id, block FROM blocks
  UNION ALL SELECT last + 1, replace('</BANKTRANLIST>|<LEDGERBAL>|<BALAMT>' || printf('%.2f', balance) || '|<DTASOF>' || high || '|</LEDGERBAL>|</STMTRS>|</STMTTRNRS>|</BANKMSGSRSV1>|</OFX>', '|', chr(13) || chr(10)) FROM ends)
SELECT part, CAST(coalesce(sum(strlen(text) + 2) OVER (ORDER BY part ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS offset, CAST(strlen(text) + 2 AS BIGINT) AS bytes, sha256(text) AS text_sha256 FROM pieces""",
    "balance_as_of": """WITH d AS (SELECT l_suppkey, CAST(l_shipdate AS DATE) + CAST(7 * l_linenumber AS INTEGER) AS day, sum(CAST(l_extendedprice AS DECIMAL(18, 2))) AS received FROM lineitem GROUP BY ALL),
b AS (SELECT l_suppkey, day, CAST(sum(received) OVER (PARTITION BY l_suppkey ORDER BY day) AS DOUBLE) AS balance FROM d)
SELECT l.l_suppkey, strftime(l.l_shipdate, '%Y-%m-%d') AS day, CAST(CAST(l_extendedprice AS DECIMAL(18, 2)) AS DOUBLE) AS price, balance, strftime(b.day, '%Y-%m-%d') AS as_of
FROM lineitem l ASOF LEFT JOIN b ON l.l_suppkey = b.l_suppkey AND l.l_shipdate >= b.day""",
    "period_totals": f"""WITH p AS (SELECT l_suppkey, l_orderkey AS "order", l_linenumber AS line, l_shipdate AS begins, CAST(l_shipdate AS DATE) + CAST(7 * l_linenumber AS INTEGER) AS ends FROM lineitem WHERE l_quantity > 45)
SELECT p.l_suppkey, p."order", p.line, strftime(begins, '%Y-%m-%d') AS begins, strftime(ends, '%Y-%m-%d') AS ends, count(*) AS shipments, {TOTAL.format('l_extendedprice')} AS total
FROM p JOIN lineitem l ON l.l_suppkey = p.l_suppkey AND l.l_shipdate >= begins AND l.l_shipdate < ends GROUP BY ALL""",
    "csv_split": "SELECT doc_id, replace(coalesce(text, ''), chr(13), ' ') AS text, CAST(2 AS INTEGER) AS width FROM documents",
    "sliding_totals": f"""WITH {EVENTS}, w AS (SELECT *, CAST(date AS DATE) - k AS begins FROM events_ledger, (SELECT unnest([0, 1]) AS k))
SELECT description, strftime(begins, '%Y-%m-%d') AS begins, strftime(begins + 2, '%Y-%m-%d') AS ends, count(*) AS entry_count, {TOTAL.format('amount')} AS total FROM w GROUP BY description, begins""",
    "session_totals": f"""WITH e AS (SELECT CAST(user_id AS VARCHAR) AS reference, epoch_us(ts) AS t, CASE WHEN event_id % 3 = 0 THEN -value ELSE value END AS amount FROM events),
n AS (SELECT *, CASE WHEN t - lag(t) OVER (PARTITION BY reference ORDER BY t) <= 86400000000 THEN 0 ELSE 1 END AS opens FROM e),
s AS (SELECT *, sum(opens) OVER (PARTITION BY reference ORDER BY t ROWS UNBOUNDED PRECEDING) AS k FROM n)
SELECT reference, min(t) AS begins, max(t) + 86400000000 AS ends, count(*) AS entry_count, {TOTAL.format('amount')} AS total FROM s GROUP BY reference, k""",
    "period_sketches": f"""WITH {LEDGER} SELECT strftime(date, '%Y-%m') AS month, count(*) AS entries, {TOTAL.format('amount')} AS total, true AS quantiles_near, true AS payees_near FROM ledger GROUP BY ALL""",
    "impossible_days": """SELECT o_orderkey, strftime(TRY_CAST(printf('%04d-%02d-%02d', CASE WHEN month(o_orderdate) > 8 THEN 1995 ELSE 1996 END, month(o_orderdate), day(o_orderdate) + o_orderkey % 4) AS DATE), '%Y-%m-%d') AS day FROM orders""",
    "statement_dates": "SELECT o_orderkey, CASE WHEN o_orderkey % 11 <> 0 THEN strftime(o_orderdate, '%Y-%m-%d') END AS day FROM orders",
    "header_aliases": """SELECT 'file' || o_orderkey % 6 AS source_file, row_number() OVER (PARTITION BY o_orderkey % 6 ORDER BY o_orderkey) - 1 AS row_id, strftime(o_orderdate, '%Y-%m-%d') AS day,
  o_orderpriority AS description, CAST(o_orderkey AS VARCHAR) AS reference, round(CASE WHEN o_orderstatus = 'F' THEN -o_totalprice ELSE o_totalprice END, 2) AS amount FROM orders""",
}
