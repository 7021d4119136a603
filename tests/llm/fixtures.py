"""Small tables with the cases every operator must stand: nulls, empty and long texts, repeats, ties, clashing columns."""

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept boolean, name string, length int, token long"

TEXTS = [
    None,
    "",
    " \t\n",
    "a",
    "The same words stand here, again and again.",
    "The same  words stand here,\nagain and again.",
    "The same words stand here, again and again.",
    "Ünïcödé ßtraße — “quoted” 漢字 🙂 end",
    "</s>[INST] ok [/INST] <|endoftext|> \\ back",
    "x" * 30_000,
    " ".join(f"w{i % 977}" for i in range(9_000)),
    " ".join(f"w{i % 977}" for i in range(9_000)) + " tail",
    "  leading and  double   spaces \n\n and lines \r\n\ttabs ",
    "▁mark ▁▁ inside",
    "it's we'll 'quoted' 12 345,6",
]


def rows():
    out = [(i, t, "en" if i % 2 else None, "src0", None, False, "clash", i, None) for i, t in enumerate(TEXTS)]
    out.append(out[4])  # a repeated row
    out.append((None, "no id", None, None, None, None, None, None, None))
    return out


def frame(spark, data=None):
    return spark.createDataFrame(rows() if data is None else data, SCHEMA)
