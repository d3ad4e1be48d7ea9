"""Built-in record layouts as data, and the spec table built from them.

A spec is a list of :class:`Field`; ``spec_table`` turns specs into the ``spec_field`` DataFrame. The tables are
a few hundred rows whatever the data size, so joining them by broadcast has a fixed bound.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession, types as T


@dataclass(frozen=True)
class Field:
    record_type: str
    name: str
    data_type: str = "alphanumeric"
    start: int | None = None
    end: int | None = None
    length: int | None = None
    required: bool = True
    nullable: bool = False
    fmt: str | None = None
    fixed: str | None = None
    default: str | None = None
    allowed: tuple[str, ...] = ()
    min_value: float | None = None
    max_value: float | None = None
    min_len: int | None = None
    max_len: int | None = None
    pattern: str | None = None
    checksum: str | None = None
    justify: str = "left"
    pad: str = " "
    depends_on: str | None = None
    condition: str | None = None
    pos: int = 0


@dataclass(frozen=True)
class Record:
    record_type: str
    name: str
    category: str
    ordering: int
    length: int | None = None
    delimiter: str | None = None


@dataclass(frozen=True)
class Spec:
    name: str
    format: str
    description: str
    records: tuple[Record, ...]
    fields: tuple[Field, ...]
    delimiter: str | None = None
    has_header: bool = False
    rules: tuple[str, ...] = field(default=())

    def of(self, record_type: str) -> list[Field]:
        return [f for f in self.fields if f.record_type == record_type]

    def record(self, record_type: str) -> Record:
        return next(r for r in self.records if r.record_type == record_type)

    @property
    def record_types(self) -> list[str]:
        return [r.record_type for r in self.records]


# ---------------------------------------------------------------------------------------------------------------
# The published ACH, card, general-ledger and MT103 layouts.
# One line per field: name, position a-b (or .), length, type, R(equired) or O(ptional), then key=value extras.
# ---------------------------------------------------------------------------------------------------------------
RIGHT_TYPES = ("numeric", "amount", "sequence")

ACH_RECORDS = (
    Record("1", "File Header", "header", 0, 94),
    Record("5", "Batch Header", "batch_header", 10, 94),
    Record("6", "Entry Detail", "detail", 20, 94),
    Record("7", "Addenda Record", "addenda", 25, 94),
    Record("8", "Batch Control", "batch_trailer", 90, 94),
    Record("9", "File Control", "trailer", 99, 94),
)
SERVICE_CLASSES = "200,220,225"
TRANSACTION_CODES = "22,23,24,27,28,29,32,33,34,37,38,39"
ENTRY_CLASSES = "PPD,CCD,CTX,WEB,TEL,ARC,BOC,POP,RCK,ENR"
ACH_FIELDS = {
    "1": """
record_type_code 1-1 1 numeric R fixed=1
priority_code 2-3 2 numeric R default=01
immediate_destination 4-13 10 routing_number R
immediate_origin 14-23 10 numeric R
file_creation_date 24-29 6 date R fmt=YYMMDD
file_creation_time 30-33 4 numeric O
file_id_modifier 34-34 1 alphanumeric R
record_size 35-37 3 numeric R fixed=094
blocking_factor 38-39 2 numeric R fixed=10
format_code 40-40 1 numeric R fixed=1
immediate_destination_name 41-63 23 alphanumeric R
immediate_origin_name 64-86 23 alphanumeric R
reference_code 87-94 8 alphanumeric O
""",
    "5": f"""
record_type_code 1-1 1 numeric R fixed=5
service_class_code 2-4 3 numeric R allowed={SERVICE_CLASSES}
company_name 5-20 16 alphanumeric R
company_discretionary_data 21-40 20 alphanumeric O
company_identification 41-50 10 alphanumeric R
standard_entry_class_code 51-53 3 alpha R allowed={ENTRY_CLASSES}
company_entry_description 54-63 10 alphanumeric R
company_descriptive_date 64-69 6 date O fmt=YYMMDD
effective_entry_date 70-75 6 date R fmt=YYMMDD
settlement_date 76-78 3 numeric O
originator_status_code 79-79 1 numeric R
odfi_identification 80-87 8 routing_number R
batch_number 88-94 7 numeric R
""",
    "6": f"""
record_type_code 1-1 1 numeric R fixed=6
transaction_code 2-3 2 numeric R allowed={TRANSACTION_CODES}
rdfi_routing_transit 4-11 8 routing_number R
check_digit 12-12 1 numeric R
dfi_account_number 13-29 17 account_number R
amount 30-39 10 amount R
individual_identification_number 40-54 15 alphanumeric O
individual_name 55-76 22 alphanumeric R
discretionary_data 77-78 2 alphanumeric O
addenda_record_indicator 79-79 1 numeric R allowed=0,1
trace_number 80-94 15 numeric R
""",
    "7": """
record_type_code 1-1 1 numeric R fixed=7
addenda_type_code 2-3 2 numeric R allowed=05
payment_related_information 4-83 80 alphanumeric O
sequence_number 84-87 4 numeric R
entry_detail_sequence_number 88-94 7 numeric R
""",
    "8": """
record_type_code 1-1 1 numeric R fixed=8
service_class_code 2-4 3 numeric R
entry_addenda_count 5-10 6 numeric R
entry_hash 11-20 10 numeric R
total_debit_amount 21-32 12 amount R
total_credit_amount 33-44 12 amount R
company_identification 45-54 10 alphanumeric R
message_authentication_code 55-73 19 alphanumeric O
reserved 74-79 6 filler O
odfi_identification 80-87 8 routing_number R
batch_number 88-94 7 numeric R
""",
    "9": """
record_type_code 1-1 1 numeric R fixed=9
batch_count 2-7 6 numeric R
block_count 8-13 6 numeric R
entry_addenda_count 14-21 8 numeric R
entry_hash 22-31 10 numeric R
total_debit_amount 32-43 12 amount R
total_credit_amount 44-55 12 amount R
reserved 56-94 39 filler O
""",
}

CARD_RECORDS = (
    Record("HEADER", "File Header", "header", 0, 220),
    Record("DETAIL", "Transaction Detail", "detail", 10, 220),
    Record("TRAILER", "File Trailer", "trailer", 99, 220),
)
CURRENCY_CODES = "840,978,826,036,124,356,392"
CARD_FIELDS = {
    "HEADER": """
record_type 1-1 1 constant R fixed=H
file_creation_date 2-7 6 date R fmt=YYMMDD
institution_id 8-18 11 numeric R
file_sequence 19-22 4 sequence R
""",
    "DETAIL": f"""
record_type 1-2 2 enum R allowed=05,06,07,08
transaction_code 3-4 2 enum R allowed=00,01,20,28,54
primary_account_number 5-20 16 pan R
processing_code 21-26 6 enum R
transaction_amount 27-36 10 amount R
transaction_currency 37-39 3 enum R allowed={CURRENCY_CODES}
transaction_date 40-45 6 date R fmt=YYMMDD
transaction_time 46-51 6 string R
expiry_date 52-55 4 expiry R
pos_entry_mode 56-58 3 enum R allowed=010,020,051,071,081,091
pos_condition_code 59-60 2 enum R
acquirer_institution_id 61-71 11 numeric R
retrieval_reference_number 72-83 12 string R
authorization_code 84-89 6 string R
response_code 90-91 2 enum R allowed=00,01,05,12,14,51,54,57,61,91
terminal_id 92-99 8 string R
merchant_id 100-115 16 string R
merchant_name 116-140 25 string R
merchant_city 141-153 13 string R
merchant_country 154-156 3 enum R
mcc 157-160 4 enum R
network_id 161-164 4 enum R allowed=0001
cvv2_result_code 165-165 1 enum R allowed=M,N,P,U,S,_
avs_result_code 166-166 1 enum R allowed=Y,N,A,Z,W,U,_
settle_date 167-172 6 date R fmt=YYMMDD
interchange_fee 173-180 8 amount R
cardholder_name 181-206 26 string R
filler 207-220 14 constant O
""",
    "TRAILER": """
record_type 1-1 1 constant R fixed=T
total_records 2-11 10 numeric R
total_amount 12-25 14 amount R
""",
}

TCR0_FIELDS = """
transaction_code 1-2 2 numeric R allowed=05,06,08,25,26,28
function_code 3-5 3 numeric R
message_reason_code 6-9 4 numeric O
card_acceptor_bin 10-15 6 numeric R
acquirer_country_code 16-18 3 numeric R
acquirer_currency_code 19-21 3 numeric R
account_number 22-35 14 numeric R
account_number_ext 36-41 6 numeric O
purchase_date 42-45 4 date R fmt=MMDD
transaction_amount 46-57 12 amount R
transaction_currency 58-60 3 numeric R
cardholder_amount 61-72 12 amount O
cardholder_currency 73-75 3 numeric O
authorization_code 76-81 6 alphanumeric R
authorization_date 82-85 4 date O fmt=MMDD
merchant_name 86-110 25 alphanumeric R
merchant_city 111-123 13 alphanumeric R
merchant_country_code 124-126 3 numeric R
merchant_zip 127-135 9 alphanumeric O
merchant_state 136-137 2 alpha O
merchant_category_code 138-141 4 numeric R
pos_entry_mode 142-143 2 numeric R allowed=01,02,03,05,07,10,90,91
"""

GL_RECORDS = (
    Record("HEADER", "Header Record", "header", 0, None, "|"),
    Record("LINE", "Journal Line Record", "detail", 10, None, "|"),
)
GL_FIELDS = {
    "HEADER": """
status . 1 alpha R allowed=N,P,C,E
ledger_id . 15 alphanumeric R
accounting_date . 11 date R fmt=DD-MON-YYYY
currency_code . 15 alpha R
date_created . 11 date O fmt=DD-MON-YYYY
created_by . 100 alphanumeric O
actual_flag . 1 alpha R allowed=A,B,E
user_je_source_name . 25 alphanumeric R
user_je_category_name . 25 alphanumeric R
encumbrance_type_id . 15 numeric O
budget_version_id . 15 numeric O
balanced_je_flag . 1 alpha O allowed=Y,N
balancing_segment_value . 25 alphanumeric O
""",
    "LINE": """
status . 1 alpha R
effective_date . 11 date R fmt=DD-MON-YYYY
code_combination_id . 15 numeric O
segment1 . 25 alphanumeric R
segment2 . 25 alphanumeric R
segment3 . 25 alphanumeric R
segment4 . 25 alphanumeric O
segment5 . 25 alphanumeric O
entered_dr . 22 amount O
entered_cr . 22 amount O
accounted_dr . 22 amount O
accounted_cr . 22 amount O
description . 240 alphanumeric O
attribute1 . 150 alphanumeric O
attribute2 . 150 alphanumeric O
reference1 . 100 alphanumeric O
reference2 . 100 alphanumeric O
""",
}

MT103_CURRENCIES = "USD,EUR,GBP,JPY,CHF,AUD,CAD,SEK,NOK,DKK,NZD,SGD,HKD,MXN,ZAR,BRL,INR,CNY,RUB,TRY,AED,SAR,THB,MYR"
MT103_FIELDS = f"""
tag_20_sender_reference . 16 alphanumeric R
tag_23b_bank_operation_code . 4 alpha R allowed=CRED,SPAY,SSTD,SPRI
tag_32a_value_date . 6 date R fmt=YYMMDD
tag_32a_currency . 3 alpha R allowed={MT103_CURRENCIES}
tag_32a_amount . 15 swift_amount R
tag_50_ordering_customer_account . 35 alphanumeric R
tag_57a_account_with_institution . 11 alphanumeric O
tag_59_beneficiary_customer . 35 alphanumeric R
tag_70_remittance_information . 140 alphanumeric O
tag_71a_details_of_charges . 3 alpha R allowed=BEN,SHA,OUR
tag_72_sender_to_receiver_info . 210 alphanumeric O
"""
MT103_REFERENCE_PATTERN = r"[A-Z0-9/\-\?:\(\)\.,' \+]{1,16}"
MT103_BIC_PATTERN = r"[A-Z]{4}[A-Z]{2}[A-Z0-9]{2}([A-Z0-9]{3})?"
# ---------------------------------------------------------------------------------------------------------------


def parse_fields(record_type: str, text: str) -> list[Field]:
    """Read one record's field lines."""
    out = []
    for pos, row in enumerate((r for r in text.strip().splitlines() if r.strip()), 1):
        name, span, length, data_type, need, *extras = row.split()
        start, end = (int(x) for x in span.split("-")) if span != "." else (None, None)
        right = data_type in RIGHT_TYPES
        f = Field(record_type, name, data_type, start, end, int(length), need == "R", pos=pos,
                  justify="right" if right else "left", pad="0" if right else " ")
        for extra in extras:
            key, value = extra.split("=", 1)
            if key == "allowed":
                f = replace(f, allowed=tuple(v.replace("_", " ") for v in value.split(",")))
            else:
                f = replace(f, **{key: value})
        out.append(f)
    return out


def _constrained_ach(f: Field) -> Field:
    extra: dict = {"min_len": f.length, "max_len": f.length}
    if f.data_type == "amount":
        extra |= {"min_value": 0.0, "max_value": 9_999_999_999.0}
    if f.name in ("check_digit", "entry_hash"):
        extra |= {"checksum": "mod10"}
    return replace(f, **extra)


def _constrained_card(f: Field) -> Field:
    extra: dict = {"min_len": f.length, "max_len": f.length}
    if f.data_type == "pan":
        extra |= {"pattern": r"[0-9]{13,19}\s*", "checksum": "luhn"}
    elif f.data_type == "expiry":
        extra |= {"pattern": "[0-9]{4}"}
    elif f.data_type == "amount":
        extra |= {"min_value": 0.0, "pattern": "[0-9]+"}
    return replace(f, **extra)


def _mt103(f: Field) -> Field:
    if f.name == "tag_20_sender_reference":
        return replace(f, pattern=MT103_REFERENCE_PATTERN)
    if f.name == "tag_57a_account_with_institution":
        return replace(f, pattern=MT103_BIC_PATTERN)
    return f


ACH = Spec(
    "ACH", "fixed_width", "ACH Automated Clearing House fixed width 94 character record format", ACH_RECORDS,
    tuple(_constrained_ach(f) for rt, text in ACH_FIELDS.items() for f in parse_fields(rt, text)),
    rules=("batch_control.entry_addenda_count = count(entries)", "file_control.batch_count = count(batches)",
           "count(lines) % 10 = 0"),
)
CARD = Spec(
    "CARD", "fixed_width", "Card clearing file with header detail and trailer", CARD_RECORDS,
    tuple(_constrained_card(f) for rt, text in CARD_FIELDS.items() for f in parse_fields(rt, text)),
    rules=("trailer.total_records = count(detail)", "trailer.total_amount = sum(detail.transaction_amount)",
           "luhn(detail.primary_account_number)"),
)
TCR0 = Spec(
    "CARD_TCR0", "fixed_width", "Card transaction core record zero", (Record("TCR0", "Transaction Core Record 0",
                                                                             "detail", 10, 145),),
    tuple(parse_fields("TCR0", TCR0_FIELDS)),
)
GL = Spec(
    "GL", "delimited", "General Ledger Journal Entry Interface flat file format", GL_RECORDS,
    tuple(f for rt, text in GL_FIELDS.items() for f in parse_fields(rt, text)), delimiter="|", has_header=True,
)
MT103 = Spec(
    "MT103", "tagged", "MT103 Single Customer Credit Transfer", (Record("MESSAGE", "MT103 Message", "detail", 0),),
    tuple(_mt103(f) for f in parse_fields("MESSAGE", MT103_FIELDS)),
)
BUILT_IN = {s.name: s for s in (ACH, CARD, TCR0, GL, MT103)}

SPEC_SCHEMA = T.StructType([
    T.StructField("spec_name", T.StringType()), T.StructField("format", T.StringType()),
    T.StructField("record_type", T.StringType()), T.StructField("record_name", T.StringType()),
    T.StructField("category", T.StringType()), T.StructField("ordering", T.IntegerType()),
    T.StructField("pos", T.IntegerType()), T.StructField("field", T.StringType()),
    T.StructField("field_type", T.StringType()), T.StructField("start", T.IntegerType()),
    T.StructField("end", T.IntegerType()), T.StructField("length", T.IntegerType()),
    T.StructField("justify", T.StringType()), T.StructField("pad", T.StringType()),
    T.StructField("format_string", T.StringType()), T.StructField("default_value", T.StringType()),
    T.StructField("fixed_value", T.StringType()),
    T.StructField("constraints", T.StructType([
        T.StructField("min_len", T.IntegerType()), T.StructField("max_len", T.IntegerType()),
        T.StructField("min_value", T.DoubleType()), T.StructField("max_value", T.DoubleType()),
        T.StructField("pattern", T.StringType()), T.StructField("allowed", T.ArrayType(T.StringType())),
        T.StructField("checksum", T.StringType()), T.StructField("required", T.BooleanType()),
        T.StructField("nullable", T.BooleanType())])),
])


def spec_rows(spec: Spec) -> list[tuple]:
    rows = []
    for f in spec.fields:
        r = spec.record(f.record_type)
        rows.append((spec.name, spec.format, f.record_type, r.name, r.category, r.ordering, f.pos, f.name, f.data_type,
                     f.start, f.end, f.length, f.justify, f.pad, f.fmt, f.default, f.fixed,
                     (f.min_len, f.max_len, f.min_value, f.max_value, f.pattern, list(f.allowed), f.checksum,
                      f.required, f.nullable)))
    return rows


def spec_table(spark: SparkSession, *specs: Spec) -> DataFrame:
    """The ``spec_field`` table: one row per spec x record type x field."""
    rows = [row for s in (specs or tuple(BUILT_IN.values())) for row in spec_rows(s)]
    return spark.createDataFrame(rows, SPEC_SCHEMA)


def spec_from_table(rows: list, name: str, delimiter: str | None = None) -> Spec:
    """Spec object from collected ``spec_field`` rows (a few dozen rows of metadata, never data)."""
    records, fields = {}, []
    for r in sorted(rows, key=lambda x: (x["ordering"], x["record_type"], x["pos"])):
        records.setdefault(r["record_type"], Record(r["record_type"], r["record_name"], r["category"], r["ordering"]))
        c = r["constraints"]
        fields.append(Field(r["record_type"], r["field"], r["field_type"], r["start"], r["end"], r["length"],
                            c["required"], c["nullable"], r["format_string"], r["fixed_value"], r["default_value"],
                            tuple(c["allowed"] or ()), c["min_value"], c["max_value"], c["min_len"], c["max_len"],
                            c["pattern"], c["checksum"], r["justify"], r["pad"], pos=r["pos"]))
    ends = {rt: max((f.end or 0) for f in fields if f.record_type == rt) for rt in records}
    recs = tuple(Record(r.record_type, r.name, r.category, r.ordering, ends[r.record_type] or None, delimiter)
                 for r in records.values())
    return Spec(name, "delimited" if delimiter else "fixed_width", "", recs, tuple(fields), delimiter)
