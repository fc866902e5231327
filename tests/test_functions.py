"""Column expressions on hand-made cells."""

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tablewright.functions import dates, numbers, payload, secrets, text


def apply(spark, cells, expression):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cells)], "i int, c string")
    return [r[1] for r in rows.select("i", expression(F.col("c"))).orderBy("i").collect()]


def test_strip_and_collapse_know_unicode_blanks(spark):
    cells = ["  a \tb \n", None, "", "x"]
    assert apply(spark, cells, text.strip_ws) == ["a \tb", None, "", "x"]
    assert apply(spark, cells, text.collapse_ws) == [" a b ", None, "", "x"]


def test_title_case_starts_words_after_any_non_alphanumeric(spark):
    cells = ["o'BRIEN anne-marie e.g. 3RD", "é.ß x_y", "  lead", None]
    assert apply(spark, cells, text.title_case) == ["O'Brien Anne-Marie E.G. 3rd", "É.SS X_Y", "  Lead", None]


def test_accents(spark):
    cells = ["México ﬁ ① ø", "plain", "한글", "é", None, ""]
    import unicodedata

    def fold(s):
        return "".join(c for c in unicodedata.normalize("NFKD", s) if not unicodedata.combining(c))

    assert apply(spark, cells, text.strip_accents) == [fold(c) if c else c for c in cells]


def test_clean_text_order_and_options(spark):
    cells = ["  jOSÉ   garcía ", "ok"]
    assert apply(spark, cells, text.clean_text) == ["José García", "Ok"]
    assert apply(spark, cells, lambda c: text.clean_text(c, "upper", remove_accents=True)) == ["JOSE GARCIA", "OK"]
    assert apply(spark, cells, lambda c: text.clean_text(c, "preserve", strip=False)) == [" jOSÉ garcía ", "ok"]


def test_slug(spark):
    cells = ["Café Acmé", "--A  b!!C--", "日本", "x" * 70]
    assert apply(spark, cells, text.slug) == ["cafe-acme", "a-b-c", "", "x" * 60]


def test_slug_suffix_is_stable_and_bounded(spark):
    first = apply(spark, ["y" * 60, ""], lambda c: text.slug_with_suffix(c, F.col("i")))
    assert first == apply(spark, ["y" * 60, ""], lambda c: text.slug_with_suffix(c, F.col("i")))
    assert len(first[0]) == 60 and first[0].startswith("y" * 50 + "y" * 7 + "--") and first[1].startswith("row--")


def test_one_line_title(spark):
    assert apply(spark, [" a\n\n b\x1cc ", "z" * 90], text.one_line_title) == ["a b c", "z" * 80]


NUMBERS = ["1,234.56", "1.234,56", "$ 1,200", "45%", "5 EUR", "Price 5", "-", "--3", "1e5", "", None, ".5", "+3", "1e400"]


def test_numbers_with_either_mark(spark):
    us = apply(spark, NUMBERS, lambda c: numbers.to_number(c, "."))
    eu = apply(spark, NUMBERS, lambda c: numbers.to_number(c, ","))
    inf = float("inf")
    assert us == [1234.56, 1.23456, 1200.0, 45.0, None, None, None, None, 1e5, None, None, 0.5, 3.0, inf]
    assert eu == [1.23456, 1234.56, 1.2, 45.0, None, None, None, None, 1e5, None, None, 5.0, 3.0, inf]


@pytest.mark.parametrize(
    "commas, dots, mark", [(0, 0, "."), (0, 5, "."), (3, 0, ","), (2, 2, "."), (3, 2, "."), (2, 3, ",")]
)
def test_decimal_mark(commas, dots, mark):
    assert numbers.pick_decimal(commas, dots) == mark


CELLS = {
    "%Y-%m-%d": ("2024-01-05", "2024-01-05 00:00:00"),
    "%Y-%m-%dT%H:%M:%S": ("2024-01-05T10:11:12", "2024-01-05 10:11:12"),
    "%Y-%m-%d %H:%M:%S": ("2024-01-05 10:11:12", "2024-01-05 10:11:12"),
    "%d/%m/%Y": ("05/01/2024", "2024-01-05 00:00:00"),
    "%d-%m-%Y": ("05-01-2024", "2024-01-05 00:00:00"),
    "%m/%d/%Y": ("01/05/2024", "2024-01-05 00:00:00"),
    "%d/%m/%Y %H:%M": ("05/01/2024 10:11", "2024-01-05 10:11:00"),
    "%d-%m-%Y %H:%M:%S": ("05-01-2024 10:11:12", "2024-01-05 10:11:12"),
}


@pytest.mark.parametrize("fmt", CELLS)
def test_default_formats(spark, fmt):
    cell, wanted = CELLS[fmt]
    got = apply(spark, [cell, cell + "x", " " + cell, None], lambda c: dates.date_format(fmt).parse(c).cast("string"))
    assert got == [wanted, None, None, None]


def test_date_edge_cells(spark):
    cells = ["2024-1-5", "2024-02-30", "2024-13-01", "2024-001-05", "0024-01-05\n"]
    got = apply(spark, cells, lambda c: dates.date_format("%Y-%m-%d").parse(c).cast("string"))
    assert got == ["2024-01-05 00:00:00", None, None, None, None]


def test_other_directives(spark):
    assert apply(spark, ["05 Jan 24 3:07 PM"], lambda c: dates.date_format("%d %b %y %I:%M %p").parse(c).cast("string")) == [
        "2024-01-05 15:07:00"
    ]
    assert dates.date_format("%Q") is None
    assert dates.date_format("%F").pattern == "yyyy-M-d"


def test_redact_text(spark):
    cells = [
        "password=abc, New_Password: xyz; ok",
        "encode foo",
        "Authorization Bearer abc.def bearer q-1",
        "nothing here",
        None,
    ]
    assert apply(spark, cells, secrets.redact_text) == [
        "password=***, New_Password: ***; ok",
        "encode ***",
        "Authorization *** abc.def Bearer ***",
        "nothing here",
        None,
    ]
    strict = apply(spark, cells, lambda c: secrets.redact_text(c, strict=True))
    assert strict[1] == "encode foo" and strict[0] == "password=***, New_Password: ***; ok"


@pytest.mark.parametrize("key", secrets.SENSITIVE_KEYS)
def test_every_key_is_masked_inline(spark, key):
    assert apply(spark, [f"x {key.upper()} = v1;"], secrets.redact_text) == [f"x {key.upper()} = ***;"]


def test_redact_json_nested(spark):
    cells = ['{"password": "x", "a": {"Token": [1], "b": "ñ"}, "l": [{"pwd": 1}]}', '["token"]', "bad \"token\":", None]
    assert apply(spark, cells, secrets.redact_json) == [
        '{"password": "***", "a": {"Token": "***", "b": "ñ"}, "l": [{"pwd": 1}]}',
        '["token"]',
        'bad "token":',
        None,
    ]


def test_redact_record(spark):
    schema = T._parse_datatype_string("r struct<code:string,more:struct<cookie:string,n:int>,m:map<string,string>>")
    row = spark.createDataFrame([((("s", ("c", 1), {"PWD": "p", "q": "r"}),))], schema)
    got = row.select(secrets.redact_record(F.col("r"), schema["r"].dataType).alias("r")).first()["r"]
    assert got["code"] == "***" and got["more"]["cookie"] == "***" and got["more"]["n"] == 1
    assert got["m"] == {"PWD": "***", "q": "r"}


def test_suggestions(spark):
    cells = [
        'Two rows left.\n\nSUGGESTIONS:["keep", "drop", "ask"]',
        'Two rows left.\n\nSUGGESTIONS:["keep"]   \n',
        "Two rows left.  ",
        "x SUGGESTIONS:[broken]",
        "x SUGGESTIONS:[]",
        'x SUGGESTIONS:["a", 1]',
        'x SUGGESTIONS:["a", null]',
        'SUGGESTIONS:["a"] more',
    ]
    assert apply(spark, cells, payload.suggestions) == [["keep", "drop", "ask"], ["keep"], *[None] * 6]
    assert apply(spark, cells, payload.without_suggestions) == ["Two rows left."] * 3 + cells[3:]


def test_tool_names_and_usage(spark):
    cells = ['{"tool_calls":[{"name":"a"},{"name":5},7,{"x":1},{"name":"b"}]}', '{"tool_calls":3}', "bad", None]
    assert apply(spark, cells, payload.tool_names) == [["a", "b"], [], [], []]
    usage = ['{"prompt":3,"completion":4}', '{"prompt":3}', None]
    assert apply(spark, usage, payload.usage_total) == [7, 3, None]


def test_number_shape_and_cast_agree(spark):
    cells = ["1", "+1.", "-.5", ".", "1e5", "1e", "e5", "1.2.3", "--1", "1e+5", "1E-5", "", "+", "1e5.0", "00012", "1-2"]
    shape = apply(spark, cells, lambda c: numbers.is_number(numbers.plain_number(c, ".")))
    assert shape == [v is not None for v in apply(spark, cells, lambda c: numbers.to_number(c, "."))]


@pytest.mark.parametrize(
    ("form", "cell", "want"),
    [
        ("%d/%m/%y", "01/02/99", "1999-02-01 00:00:00"),
        ("%d/%m/%y", "01/02/68", "2068-02-01 00:00:00"),
        ("%D", "12/31/69", "1969-12-31 00:00:00"),
        ("%Y-%m-%d %H:%M:%S%.f", "2024-01-02 03:04:05.12", "2024-01-02 03:04:05.12"),
        ("%Y-%m-%d %H:%M:%S%.f", "2024-01-02 03:04:05", "2024-01-02 03:04:05"),
        ("%Y-%m-%d %H:%M:%S%.3f", "2024-01-02 03:04:05.123", "2024-01-02 03:04:05.123"),
        ("%Y-%m-%d %H:%M:%S%.3f", "2024-01-02 03:04:05.12", None),
        ("%Y-%m-%d %H:%M:%S.%f", "2024-01-02 03:04:05.5", "2024-01-02 03:04:05.5"),
        ("%Y-%m-%d %H:%M:%S.%6f", "2024-01-02 03:04:05.123456", "2024-01-02 03:04:05.123456"),
        ("%%y %Y", "%y 2024", "2024-01-01 00:00:00"),
    ],
)
def test_date_directives(spark, form, cell, want):
    got = apply(spark, [cell], lambda c: dates.date_format(form).parse(c).cast("string"))
    assert got == [want]
