"""Checksum, date and numeric predicates as SQL expression text: native, code-generated, no UDF.

Every function takes the text of a string expression and returns expression text, to be used with ``F.expr``.
"""

from __future__ import annotations

from tallyframe.functions.sqltext import q

# Routing weights, accepted date formats (shape, parse pattern).
ABA_WEIGHTS = (3, 7, 1, 3, 7, 1, 3, 7, 1)
DATE_FORMATS = {
    "YYMMDD": ("^[0-9]{6}$", "yyMMdd"),
    "YYYYMMDD": ("^[0-9]{8}$", "yyyyMMdd"),
    "MMDD": ("^[0-9]{4}$", "MMdd"),
    "DD-MON-YYYY": ("^[0-9]{2}-[A-Za-z]{3}-[0-9]{4}$", "dd-MMM-yyyy"),
}
NUMBER_SHAPE = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$"

def only_digits(x: str) -> str:
    return f"regexp_replace({x}, '[^0-9]', '')"


def _digit(x: str, position: int) -> str:
    return f"(ascii(substring({x}, {position}, 1)) - 48)"


def _luhn_terms(n: str, double_rightmost: bool) -> str:
    """Luhn sum of a number of up to 18 digits: nine pairs of digits, each looked up, instead of two calls a digit."""
    pairs = [(lambda two: two[double_rightmost] + 2 * two[1 - double_rightmost] - 9 * (two[1 - double_rightmost] > 4))((n % 10, n // 10)) for n in range(100)]
    table = f"array({', '.join(map(str, pairs))})"
    return " + ".join(f"{table}[cast({n} div {100 ** k}L % 100 as int)]" for k in range(9))


def _luhn_sum(d: str, double_rightmost: bool) -> str:
    """Luhn sum of a digit string of any length; doubling starts at the last or the last but one digit. The digit
    string occurs once in the text, so nested uses do not multiply the expression."""
    doubled = f"i % 2 = {0 if double_rightmost else 1}"
    digit = f"if(c = '', 0, (ascii(c) - 48) * if({doubled}, 2, 1) - if({doubled} and c > '4', 9, 0))"
    each = f"aggregate(transform(split(reverse(v), ''), (c, i) -> {digit}), 0, (a, x) -> a + x)"
    return f"aggregate(array({d}), 0, (s, v) -> if(v rlike '^[0-9]{{1,18}}$', aggregate(array(cast(v as bigint)), 0, (b, n) -> {_luhn_terms('n', double_rightmost)}), {each}))"


def luhn_ok(x: str) -> str:
    """True when the digits of the value (13 or more) pass the Luhn test. Values of 13 to 18 digits and nothing else, which are nearly all
    card numbers, are tested without a lambda."""
    d = only_digits(f"coalesce({x}, '')")
    plain = f"({_luhn_terms(f'cast({x} as bigint)', False)}) % 10 = 0"
    return f"if(coalesce({x} rlike '^[0-9]{{13,18}}$', false), {plain}, length({d}) >= 13 and {_luhn_sum(d, False)} % 10 = 0)"


def luhn_check_digit(partial: str) -> str:
    """The digit that completes a partial card number."""
    return f"((10 - {_luhn_sum(partial, True)} % 10) % 10)"


def aba_sum(x: str, places: int) -> str:
    return "(" + " + ".join(f"{_digit(x, i + 1)} * {ABA_WEIGHTS[i]}" for i in range(places)) + ")"


def aba_ok(x: str) -> str:
    """True for nine digits whose weighted sum is a multiple of ten."""
    return f"coalesce({x} rlike '^[0-9]{{9}}$' and {aba_sum(x, 9)} % 10 = 0, false)"


def aba_check_digit(first8: str) -> str:
    """Ninth routing digit; null unless the input is eight digits."""
    return f"if({first8} rlike '^[0-9]{{8}}$', (10 - {aba_sum(first8, 8)} % 10) % 10, null)"


def date_ok(x: str, fmt: str | None) -> str:
    """Shape test and calendar test; an unknown format falls back to YYMMDD."""
    shape, pattern = DATE_FORMATS.get(fmt or "YYMMDD", DATE_FORMATS["YYMMDD"])
    return f"(coalesce({x}, '') rlike {q(shape)} and try_to_timestamp({x}, {q(pattern)}) is not null)"


def to_number(x: str) -> str:
    """Numeric coercion after dropping thousands commas and dollar signs; null when not a number."""
    cleaned = f"trim(translate({x}, ',$', ''))"
    return f"try_cast(if({cleaned} rlike {q(NUMBER_SHAPE)}, {cleaned}, null) as double)"


def full_match(x: str, pattern: str) -> str:
    return f"({x} rlike {q(f'^(?:{pattern})$')})"


def swift_amount_to_cents(x: str) -> str:
    """'25000,00' -> 2500000; null unless digits, one comma, digits."""
    return (f"cast(round(try_cast(if({x} rlike '^[0-9]+,[0-9]*$', replace({x}, ',', '.'), null) as decimal(30,4))"
            f" * 100) as bigint)")


def cents_to_swift_amount(x: str) -> str:
    return f"concat(cast({x} div 100 as string), ',', lpad(cast({x} % 100 as string), 2, '0'))"
