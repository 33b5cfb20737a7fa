"""From info-bar text to a calibrated, cross-checked image scale."""

from pyspark.sql import Column, DataFrame, functions as F

from granulith import constants as K

# Letters the reader confuses with digits, in labels and in magnifications.
LABEL_DIGITS = ("uoqzsbglit", "0002589111")
MAG_DIGITS = ("OoDQlI|SB", "000011158")

# How labels, magnifications and detector names are written on the info bar.
LABEL_PATTERN = r"(?U)([0-9uoqzsbgli.,]+?)\s*(nm|µm|um|pm|mm|m)\b"
MAG_PATTERN = r"^\s*([\dOoDQlIS|B][\dOoDQlIS|B ]*)"
MAG_SIGN_PATTERN = r"(?U)(\d[\dOo ]*)\s*[xX×]\b"
MAG_RANGE = (10, 2000000)
DETECTOR_PATTERN = "(CBS|ETD|SE2|INLENS|BSE|TLD|SE)"


def _label_parts(text: Column) -> tuple[Column, Column]:
    t = F.lower(F.replace(text, F.lit("μ"), F.lit("µ")))
    # the token grows only as far as the unit allows, so "5um" is 5 µm and not 50 m
    raw = F.translate(F.regexp_extract(t, LABEL_PATTERN, 1), *LABEL_DIGITS)
    raw = F.regexp_replace(F.translate(raw, ",", "."), r"^\.+|\.+$", "")
    return raw, F.regexp_extract(t, LABEL_PATTERN, 2)


def _unit_nm(unit: Column) -> Column:
    out = F.lit(None).cast("double")
    for name, nm in K.UNIT_NM.items():
        out = F.when(unit == name, nm).otherwise(out)
    return out


def parse_label(text: Column) -> Column:
    """Label length in nm, or null if the text holds no positive length."""
    raw, unit = _label_parts(text)
    value = F.when(raw.rlike(r"^\d+(\.\d+)?$"), raw.try_cast("double"))
    return F.when(value > 0, value * _unit_nm(unit))


def label_text(text: Column) -> Column:
    """The label as shown: the number without trailing zeros and nm or µm."""
    raw, unit = _label_parts(text)
    shown = F.when(raw.contains("."), F.regexp_replace(raw, r"\.?0+$", "")).otherwise(raw)
    return F.when(parse_label(text).isNotNull(),
                  F.concat(shown, F.lit(" "), F.when(unit == "nm", "nm").otherwise("µm")))


def _mag_value(text: Column) -> Column:
    digits = F.regexp_extract(text, MAG_PATTERN, 1)
    n = F.replace(F.translate(digits, *MAG_DIGITS), F.lit(" "), F.lit("")).try_cast("long")
    return F.when(n.between(*MAG_RANGE), n)


def magnification(fields: Column) -> Column:
    """From the MAG field, else from the number before an x sign in any field; 0 = none."""
    mags = F.map_values(F.map_filter(fields, lambda k, v: F.startswith(k, F.lit("MAG"))))
    signs = F.flatten(F.transform(F.map_values(fields), lambda v: F.regexp_extract_all(
        v, F.lit(MAG_SIGN_PATTERN), F.lit(1))))
    texts = F.when(F.size(mags) > 0, mags).otherwise(signs)
    first = F.try_element_at(F.array_compact(F.transform(texts, _mag_value)), F.lit(1))
    return F.coalesce(first, F.lit(0))


def detector(fields: Column) -> Column:
    cells = F.map_values(F.map_filter(fields, lambda k, v: F.startswith(k, F.lit("DET"))))
    names = F.filter(F.transform(cells, lambda v: F.regexp_extract(
        F.upper(v), DETECTOR_PATTERN, 1)), lambda v: v != "")
    return F.coalesce(F.try_element_at(names, F.lit(1)), F.lit(""))


def instrument(fields: Column) -> Column:
    text = F.upper(F.array_join(F.transform(F.map_entries(fields), lambda e: F.concat_ws(
        " ", e["key"], e["value"])), "\n"))
    out = F.lit("")
    for name in K.INSTRUMENT_K_MM:
        out = F.when(text.contains(name), name).otherwise(out)
    return out


def plausible(npp: Column) -> Column:
    return (npp >= K.MIN_NM_PER_PX) & (npp <= K.MAX_NM_PER_PX)


def hfw_npp(fields: Column, width: Column) -> Column:
    """nm per pixel from the field-width cell, or 0 if there is no usable one."""
    cells = F.map_values(F.map_filter(fields, lambda k, v: F.startswith(k, F.lit("HFW"))))
    values = F.filter(F.transform(cells, lambda v: parse_label(v) / width), plausible)
    return F.coalesce(F.try_element_at(values, F.lit(1)), F.lit(0.0))


def _three_digits(v: Column) -> Column:
    """A number with three significant digits and no trailing zeros, as text."""
    step = F.pow(F.lit(10.0), 2 - F.floor(F.log10(v)))
    return F.regexp_replace((F.rint(v * step) / step).cast("string"), r"\.0$", "")


def read_bar(raw: DataFrame) -> DataFrame:
    """Bar and field width to one reading; the field width outranks the bar.

    `raw` has image_id, width_px, bar_px, label_ocr and the map `fields`.
    """
    staged = raw.withColumns({
        "label_nm": parse_label(F.col("label_ocr")), "label_text": label_text(F.col("label_ocr")),
        "hfw_npp": hfw_npp(F.col("fields"), F.col("width_px"))})
    staged = staged.withColumn("bar_npp", F.col("label_nm") / F.nullif(F.col("bar_px"), F.lit(0)))
    bar_ok = F.coalesce(plausible(F.col("bar_npp")), F.lit(False))
    has_hfw = F.col("hfw_npp") > 0
    far = F.abs(F.col("hfw_npp") - F.col("bar_npp")) / F.nullif(F.col("hfw_npp"), F.lit(0.0)) > K.HFW_BAR_TOL
    note = (F.when(~bar_ok & F.col("label_nm").isNull(),
                   F.when(has_hfw, "label_unreadable_hfw").otherwise("label_unreadable"))
            .when(~bar_ok, F.when(has_hfw, "implausible_hfw").otherwise("implausible"))
            .when(has_hfw & far, "hfw_bar_disagree").otherwise(""))
    return staged.select(
        "image_id", "width_px", "bar_px", "fields",
        F.when(has_hfw, F.col("hfw_npp")).when(bar_ok, F.col("bar_npp")).otherwise(0.0).alias("nm_per_px"),
        F.when(bar_ok, F.col("label_nm")).when(has_hfw, F.col("hfw_npp") * F.col("width_px"))
         .otherwise(0.0).alias("label_nm"),
        F.when(bar_ok, F.col("label_text")).when(has_hfw, F.concat(
            F.lit("HFW "), _three_digits(F.col("hfw_npp") * F.col("width_px") / 1000), F.lit(" µm")))
         .otherwise("").alias("label_text"),
        (has_hfw | bar_ok).alias("ok"), F.when(has_hfw, "HFW").otherwise("bar").alias("source"),
        note.alias("note"), (F.col("hfw_npp") * F.col("width_px")).alias("hfw_nm"),
        detector(F.col("fields")).alias("detector"))


def cross_check(readings: DataFrame) -> DataFrame:
    """Hold the scale against the magnification where the instrument's constant is known."""
    k = F.lit(None).cast("double")
    for name, mm in K.INSTRUMENT_K_MM.items():
        k = F.when(F.col("instrument") == name, mm).otherwise(k)
    staged = readings.withColumns({"mag": magnification(F.col("fields")),
                                   "instrument": instrument(F.col("fields"))})
    known = k.isNotNull() & (F.col("mag") > 0) & (F.col("source") != "HFW")
    staged = staged.withColumn("mag_npp", F.when(
        known, k * 1e6 / (F.col("width_px") * F.col("mag"))).otherwise(0.0))
    ratio = F.try_divide("nm_per_px", "mag_npp")
    staged = staged.withColumn("_ratio", F.when(F.col("ok") & (F.col("mag_npp") > 0), ratio))
    decade = F.rint(F.log10("_ratio"))
    labels = F.array(*[F.lit(float(v)) for v in K.STANDARD_LABELS_NM])
    fits = F.when(F.col("bar_px") > 0, F.filter(labels, lambda v: F.abs(
        v / F.nullif(F.col("mag_npp") * F.col("bar_px"), F.lit(0.0)) - 1) <= K.MAG_TOL))
    staged = staged.withColumn("_fits", F.when(F.col("_ratio").isNotNull(), fits))
    one = F.coalesce(F.size("_fits") == 1, F.lit(False))
    check = (F.when(F.col("mag_npp") == 0, "").when(~F.col("ok"), "mag_only")
             .when(F.abs(F.col("_ratio") - 1) <= K.MAG_TOL, "agree")
             .when((decade != 0) & (F.abs(F.col("_ratio") / F.pow(F.lit(10.0), decade) - 1) <= K.MAG_TOL), "mag_misread")
             .when(one, "label_fixed").otherwise("conflict"))
    staged = staged.withColumn("check", check)
    fixed, by_mag = F.col("check") == "label_fixed", F.col("check").isin("mag_only", "conflict")
    new = F.try_element_at("_fits", F.lit(1))
    new_text = F.when(new < 1000, F.concat(new.cast("long").cast("string"), F.lit(" nm"))).otherwise(
        F.concat((new / 1000).cast("long").cast("string"), F.lit(" µm")))
    return staged.withColumns({
        "label_read": F.when(fixed, F.col("label_text")).otherwise(""),
        "label_text": F.when(fixed, new_text).otherwise(F.col("label_text")),
        "label_nm": F.when(fixed, new).otherwise(F.col("label_nm")),
        "nm_per_px": F.when(fixed, new / F.col("bar_px")).when(by_mag, F.col("mag_npp"))
                      .otherwise(F.col("nm_per_px")),
        "source": F.when(by_mag, "mag").otherwise(F.col("source")),
        "ok": F.col("ok") | (F.col("check") == "mag_only"),
    }).drop("_ratio", "_fits", "fields")


def valid_overrides(overrides: DataFrame) -> DataFrame:
    """Hand-set scales that may be stored: a bar with a length and a label with a value."""
    bar = F.col("right_x") - F.col("left_x")
    return (overrides.where((bar > 0) & (F.col("label_nm") > 0))
            .withColumn("bar_px", bar).withColumn("nm_per_px", F.col("label_nm") / bar))


def with_manual(readings: DataFrame, sizes: DataFrame, overrides: DataFrame) -> DataFrame:
    """A hand-set scale outranks the reader while the file still has the recorded size."""
    o = overrides.select("image_id", F.col("size").alias("_size"), F.col("nm_per_px").alias("_npp"),
                         F.col("bar_px").alias("_bar"), F.col("label_nm").alias("_label"))
    j = (readings.join(sizes.select("image_id", F.col("size").alias("_now")), "image_id", "left")
         .join(o, "image_id", "left"))
    use = F.coalesce(F.col("_size") == F.col("_now"), F.lit(False))
    return j.withColumns({
        "nm_per_px": F.when(use, F.col("_npp")).otherwise(F.col("nm_per_px")),
        "bar_px": F.when(use, F.col("_bar")).otherwise(F.col("bar_px")),
        "label_nm": F.when(use, F.col("_label")).otherwise(F.col("label_nm")),
        "source": F.when(use, "manual").otherwise(F.col("source")),
        "check": F.when(use, "manual").otherwise(F.col("check")),
        "ok": F.col("ok") | use,
    }).drop("_size", "_npp", "_bar", "_label", "_now")


def clear_override(overrides: DataFrame, images: DataFrame) -> DataFrame:
    return overrides.join(images.select("image_id"), "image_id", "left_anti")


def adopt(images: DataFrame, readings: DataFrame) -> DataFrame:
    """Take a fresh reading as evidence only if it is within 0.5 % of the scale in use."""
    r = readings.select("image_id", F.col("nm_per_px").alias("_npp"), F.col("ok").alias("_ok"))
    near = (F.col("_ok") & (F.col("nm_per_px") > 0) & (F.col("_npp") > 0)
            & (F.abs(F.try_divide("_npp", "nm_per_px") - 1) <= K.ADOPT_TOL))
    return (images.join(r, "image_id", "left")
            .select("image_id", "nm_per_px", F.coalesce(near, F.lit(False)).alias("adopted")))


def verdict(used_npp: Column) -> tuple[Column, Column]:
    """(level, short text) of a reading row; a null `ok` means there is no reading at all."""
    ok = F.col("ok") & (F.col("nm_per_px") > 0)
    chk = F.col("check")
    cases = [(F.col("ok").isNull() & (used_npp > 0), "info", "not checked"),
             (F.col("ok").isNull() | ~ok, "bad", "scale not read"),
             (F.col("source") == "manual", "info", "set by hand"),
             (F.col("source") == "HFW", "good", "from HFW"),
             (chk.isin("agree", "mag_misread"), "good", "confirmed"),
             (chk == "label_fixed", "warn", "label corrected"),
             (chk == "mag_only", "warn", "from magnification"),
             (chk == "conflict", "warn", "check this")]
    level, short = F.lit("info"), F.lit("not cross-checked")
    for cond, lv, tx in reversed(cases):
        level, short = F.when(cond, lv).otherwise(level), F.when(cond, tx).otherwise(short)
    return level, short
