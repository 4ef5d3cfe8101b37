"""Small corpora derived from the relational tables, one text for each key, the same in Spark and in ANSI SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession


def _pad(x: str, n: int) -> str:
    return f"lpad(cast({x} as string), {n}, '0')"


#: name -> table, key, text
CORPORA = {
    "phone": ("customer", "c_custkey", "'Telephone: +91 ' || substr(cast(9000000000 + c_custkey * 7919 as string), 1, 5) || ' ' || substr(cast(9000000000 + c_custkey * 7919 as string), 6, 5) || '.'"),
    "std": ("supplier", "s_suppkey", f"'Fax 022-' || {_pad('20000000 + s_suppkey * 7919', 8)}"),
    "ssn": ("customer", "c_custkey", f"'SSN ' || {_pad('c_custkey % 900 + 100', 3)} || '-' || {_pad('c_custkey % 99 + 1', 2)} || '-' || {_pad('c_custkey % 9999 + 1', 4)}"),
    "dob": ("customer", "c_custkey", f"'DOB: ' || {_pad('c_custkey % 28 + 1', 2)} || '/' || {_pad('c_custkey % 12 + 1', 2)} || '/' || cast(1950 + c_custkey % 50 as string)"),
    "din": ("customer", "c_custkey", f"case c_custkey % 3 when 0 then '' when 1 then 'DIN ' else 'Shares ' end || {_pad('c_custkey', 8)}"),
    "org": ("supplier", "s_suppkey", "'appointed ' || case s_suppkey % 3 when 0 then 'Alder' when 1 then 'Birch' else 'Cedar' end || ' Freight ' || case s_suppkey % 2 when 0 then 'Private Limited' else 'Family Trust' end || ' as agent'"),
    "pair": ("customer", "c_custkey", "case c_custkey % 4 when 0 then 'Asha Rao' when 1 then 'Ravi Nair' when 2 then 'Order Id' else 'Contact Person' end || ': ' || case c_custkey % 2 when 0 then 'John Doe' else 'A-5561' end"),
    "addr": ("customer", "c_custkey", "cast(c_custkey as string) || ' Maple Road, Pune ' || cast(411000 + c_custkey % 100 as string)"),
    "role": ("customer", "c_custkey", "case c_custkey % 3 when 0 then 'being Asha Rao of the board' when 1 then 'Ravi Nair is our promoter since' else 'being our Finance Act' end"),
    "caps": ("supplier", "s_suppkey", "case s_suppkey % 3 when 0 then 'OUR PROMOTERS: ASHA RAO' when 1 then 'Directors: RAVI NAIR' else 'RISKS: ASHA RAO' end"),
    "contact": ("supplier", "s_suppkey", "case s_suppkey % 3 when 0 then 'Contact Person: Asha Rao, Company Secretary' when 1 then 'Contact persons: Ravi Nair; others' else 'Contact Person: Asha Rao E-mail' end"),
    "split": ("customer", "c_custkey", "case c_custkey % 4 when 3 then 'prose of no name' when 2 then 'Limited' when 1 then case (c_custkey - c_custkey % 4) % 8 when 0 then 'Freight Private' else 'Works Private' end else case c_custkey % 8 when 0 then 'Alder' else 'Birch' end end"),
    "seq": ("customer", "c_custkey", "case c_custkey % 4 when 0 then 'Asha Rao' when 1 then 'Managing Director' when 2 then 'DIN' else lpad(cast(c_custkey as string), 8, '0') end"),
}


def units(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """k, text of a derived corpus."""
    table, key, text = CORPORA[name]
    return spark.read.parquet(f"{sf_dir}/{table}.parquet").selectExpr(f"{key} AS k", f"{text} AS text")


def units_sql(name: str) -> str:
    table, key, text = CORPORA[name]
    return f"(SELECT {key} AS k, {text} AS text FROM {table})"
