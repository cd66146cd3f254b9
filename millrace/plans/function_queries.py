"""Queries that call the functions of the library, family by family, with their SQL."""

from __future__ import annotations

from functools import cache
from typing import Any

from millrace.plans.engine_queries import Query, frame


class _Nothing:
    """Takes any call: stands for the library where only the SQL is read, which needs no session."""

    def __getattr__(self, name: str) -> _Nothing:
        return self

    def __call__(self, *args: Any, **kw: Any) -> _Nothing:
        return self

    __getitem__ = __add__ = __radd__ = __sub__ = __rsub__ = __mul__ = __mod__ = __gt__ = __lt__ = __call__


def families(F: Any, S: Any, col: Any, lit: Any) -> dict[str, tuple[str, str, dict[str, tuple[Any, str | None]]]]:
    """name -> (table, its key, {column: (expression, SQL or None)})."""
    out: dict[str, Any] = {}

    def family(name: str, source: str, key: str, calls: dict[str, tuple]) -> None:
        out[name] = (source, key, calls)

    def near(make, *args):
        """A double rounded for comparison."""
        return F.round(make(*args), 6)


    V, K = col("value"), col("event_id")
    U = col("l_discount")  # 0 to 0.1

    _ONE = {n: f"{n}(l_discount)" for n in ("acos", "asin", "atan", "asinh", "atanh", "cos", "cosh", "sin", "sinh", "tan", "tanh", "exp", "cbrt", "sqrt", "degrees", "radians")}
    family(
        "fn_trigonometry", "lineitem", "l_orderkey",
        {f"f_{n}": (near(getattr(F, n), U), f"round({q}, 6)") for n, q in _ONE.items()}
        | {
            "f_acosh": (near(lambda: F.acosh(U + 1)), "round(acosh(l_discount + 1), 6)"), "f_cot": (near(lambda: F.cot(U + 1)), "round(cot(l_discount + 1), 6)"),
            "f_atan2": (near(F.atan2, U, col("l_quantity")), "round(atan2(l_discount, l_quantity), 6)"), "f_pi": (near(F.pi), "round(pi(), 6)"),
            "f_ln": (near(F.ln, col("l_quantity")), "round(ln(l_quantity), 6)"), "f_log10": (near(F.log10, col("l_quantity")), "round(log10(l_quantity), 6)"),
            "f_log2": (near(F.log2, col("l_quantity")), "round(log2(l_quantity), 6)"), "f_log": (near(F.log, lit(3.0), col("l_quantity")), "round(ln(l_quantity) / ln(3.0), 6)"),
            "f_power": (near(F.power, U, lit(2)), "round(pow(l_discount, 2), 6)"), "f_pow": (near(F.pow, U, lit(3)), "round(pow(l_discount, 3), 6)"),
        },
    )

    D = V - 50
    family(
        "fn_numbers", "events", "event_id",
        {
            "f_abs": (F.abs(D), "abs(value - 50)"), "f_ceil": (F.ceil(D) + 0.0, "CAST(ceil(value - 50) AS DOUBLE) + 0.0"), "f_floor": (F.floor(D), "CAST(floor(value - 50) AS DOUBLE)"),
            "f_round": (F.round(D) + 0.0, "round(value - 50) + 0.0"), "f_round1": (F.round(V, 1), "round(CAST(CAST(value AS VARCHAR) AS DECIMAL(18,6)), 1)::DOUBLE"), "f_trunc": (F.trunc(D) + 0.0, "trunc(value - 50) + 0.0"),
            "f_signum": (F.signum(D), "CAST(sign(value - 50) AS DOUBLE)"), "f_gcd": (F.gcd(K, lit(360)), "gcd(event_id, 360)"), "f_lcm": (F.lcm(K, lit(12)), "lcm(event_id, 12)"),
            "f_factorial": (F.factorial((K % 20).cast(int)), "CAST(factorial(CAST(event_id % 20 AS INTEGER)) AS BIGINT)"), "f_isnan": (F.isnan(V), "isnan(value)"), "f_iszero": (F.iszero(K % 7), "event_id % 7 = 0"),
            "f_nanvl": (F.nanvl(V, lit(0.0)), "value"), "f_nullif": (F.nullif(K % 3, lit(0).cast("bigint")), "nullif(event_id % 3, 0)"), "f_coalesce": (F.coalesce(F.nullif(K % 3, lit(0).cast("bigint")), K), "coalesce(nullif(event_id % 3, 0), event_id)"),
            "f_to_hex": (F.to_hex(K), "lower(to_hex(event_id))"), "f_in": (F.in_list(K % 5, [1, 2]), "event_id % 5 IN (1, 2)"), "f_not_in": (F.in_list(K % 5, [1, 2], negated=True), "event_id % 5 NOT IN (1, 2)"),
            "f_case": (F.case(K % 3).when(0, "zero").when(1, "one").otherwise("more"), "CASE event_id % 3 WHEN 0 THEN 'zero' WHEN 1 THEN 'one' ELSE 'more' END"),
            "f_when": (F.when(V > 50, "big").when(V > 20, "mid").end(), "CASE WHEN value > 50 THEN 'big' WHEN value > 20 THEN 'mid' END"),
            "f_between": (V.between(20, 40), "value BETWEEN 20 AND 40"), "f_cast": (V.cast(int), "CAST(trunc(value) AS BIGINT)"), "f_reflected": (1 - K, "1 - event_id"),
        },
    )

    N = col("c_name")
    M = col("c_mktsegment")
    family(
        "fn_text", "customer", "c_custkey",
        {
            "f_ascii": (F.ascii(N), "ascii(c_name)"), "f_bit_length": (F.bit_length(N), "CAST(bit_length(c_name) AS INTEGER)"), "f_btrim": (F.btrim(F.concat("  ", M, " ")), "trim('  ' || c_mktsegment || ' ')"),
            "f_ltrim": (F.ltrim(F.concat("  ", M, " ")), "ltrim('  ' || c_mktsegment || ' ')"), "f_rtrim": (F.rtrim(F.concat("  ", M, " ")), "rtrim('  ' || c_mktsegment || ' ')"), "f_trim": (F.trim(F.concat(" ", M)), "trim(' ' || c_mktsegment)"),
            "f_character_length": (F.character_length(N), "CAST(length(c_name) AS INTEGER)"), "f_length": (F.length(M), "CAST(length(c_mktsegment) AS INTEGER)"), "f_char_length": (F.char_length(M), "CAST(length(c_mktsegment) AS INTEGER)"),
            "f_octet_length": (F.octet_length(N), "CAST(strlen(c_name) AS INTEGER)"), "f_chr": (F.chr(col("c_custkey") + 900), "chr(CAST(c_custkey + 900 AS INTEGER))"), "f_concat": (F.concat(N, None, col("c_nationkey")), "concat(c_name, NULL, c_nationkey)"),
            "f_concat_ws": (F.concat_ws("-", N, None, M), "concat_ws('-', c_name, NULL, c_mktsegment)"), "f_ends_with": (F.ends_with(M, "Y"), "suffix(c_mktsegment, 'Y')"), "f_starts_with": (F.starts_with(M, "B"), "prefix(c_mktsegment, 'B')"),
            "f_find_in_set": (F.find_in_set(M, "MACHINERY,BUILDING"), "CAST(coalesce(list_position(['MACHINERY', 'BUILDING'], c_mktsegment), 0) AS INTEGER)"), "f_initcap": (F.initcap(F.concat(M, "-x ", M)), "upper(c_mktsegment[1]) || lower(c_mktsegment[2:]) || '-X ' || upper(c_mktsegment[1]) || lower(c_mktsegment[2:])"),
            "f_instr": (F.instr(N, "er"), "CAST(strpos(c_name, 'er') AS INTEGER)"), "f_position": (F.position(N, "zz"), "CAST(strpos(c_name, 'zz') AS INTEGER)"), "f_strpos": (F.strpos(N, "0"), "CAST(strpos(c_name, '0') AS INTEGER)"),
            "f_left": (F.left(N, 3), "left(c_name, 3)"), "f_left_neg": (F.left(N, -3), "left(c_name, -3)"), "f_right": (F.right(N, 3), "right(c_name, 3)"), "f_right_neg": (F.right(N, -3), "right(c_name, -3)"),
            "f_levenshtein": (F.levenshtein(N, M), "CAST(levenshtein(c_name, c_mktsegment) AS INTEGER)"), "f_lower": (F.lower(M), "lower(c_mktsegment)"), "f_upper": (F.upper(N), "upper(c_name)"),
            "f_lpad": (F.lpad(M, 12, "xy"), "lpad(c_mktsegment, 12, 'xy')"), "f_rpad": (F.rpad(M, 5, "xy"), "rpad(c_mktsegment, 5, 'xy')"), "f_repeat": (F.repeat(M, 2), "repeat(c_mktsegment, 2)"), "f_replace": (F.replace(M, "E", "__"), "replace(c_mktsegment, 'E', '__')"),
            "f_reverse": (F.reverse(N), "reverse(c_name)"), "f_split_part": (F.split_part(N, "#", 2), "split_part(c_name, '#', 2)"), "f_substr": (F.substr(N, 4), "substring(c_name, 4)"), "f_substring": (F.substring(N, 2, 5), "substring(c_name, 2, 5)"),
            "f_substring_0": (F.substring(N, -1, 4), "left(c_name, 2)"), "f_substr_index": (F.substr_index(N, "e", 1), "split_part(c_name, 'e', 1)"), "f_translate": (F.translate(M, "AEI", "12"), "translate(c_mktsegment, 'AEI', '12')"),
            "f_overlay": (F.overlay(M, "__", 2, 3), "left(c_mktsegment, 1) || '__' || substring(c_mktsegment, 5)"), "f_alias": (F.alias(M, "m"), "c_mktsegment"), "f_col": (F.col("c_name"), "c_name"),
        },
    )

    family(
        "fn_hash", "customer", "c_custkey",
        {
            "f_md5": (F.md5(N), "md5(c_name)"), "f_sha256": (F.encode(F.sha256(N), "hex"), "sha256(c_name)"),
            "f_digest_md5": (F.encode(F.digest(N, "md5"), "hex"), "md5(c_name)"), "f_digest_sha": (F.encode(F.digest(N, "sha256"), "hex"), "sha256(c_name)"),
            "f_base64": (F.encode(N, "base64"), "rtrim(to_base64(encode(c_name)), '=')"), "f_hex": (F.encode(N, "hex"), "lower(hex(encode(c_name)))"),
            "f_decode": (F.decode(F.encode(N, "base64"), "base64").cast(str), "c_name"), "f_decode_hex": (F.decode(F.encode(N, "hex"), "hex").cast(str), "c_name"),
        },
    )
    family(
        "fn_hash_long", "customer", "c_custkey",
        {f"f_{n}": (F.encode(getattr(F, n)(N), "hex"), None) for n in ("sha224", "sha384", "sha512")} | {"f_blake2s": (F.encode(F.digest(N, "blake2s"), "hex"), None), "f_blake2b": (F.encode(F.digest(N, "blake2b"), "hex"), None)},
    )

    P = col("p_name")
    family(
        "fn_regexp", "part", "p_partkey",
        {
            "f_like": (F.regexp_like(P, "^[a-m]", "i"), "regexp_matches(p_name, '^[a-m]', 'i')"), "f_match": (F.array_to_string(F.regexp_match(col("p_brand"), r"Brand#(\d)"), ","), r"CASE WHEN regexp_matches(p_brand, 'Brand#(\d)') THEN regexp_extract(p_brand, 'Brand#(\d)', 1) END"),
            "f_match_whole": (F.array_element(F.regexp_match(P, "[aeiou]+"), 1), "CASE WHEN regexp_matches(p_name, '[aeiou]+') THEN regexp_extract(p_name, '[aeiou]+') END"), "f_first": (F.regexp_replace(P, "[aeiou]", "*"), "regexp_replace(p_name, '[aeiou]', '*')"),
            "f_all": (F.regexp_replace(P, "([aeiou])", r"<\1>", "g"), r"regexp_replace(p_name, '([aeiou])', '<\1>', 'g')"), "f_all_i": (F.regexp_replace(P, "A", "_", "gi"), "regexp_replace(p_name, 'A', '_', 'gi')"),
        },
    )

    T = col("ts")
    family(
        "fn_dates", "events", "event_id",
        {f"f_{p}": (F.date_part(p, T), f"CAST(date_part('{p}', ts) AS DOUBLE)") for p in ("year", "quarter", "month", "week", "day", "hour", "minute", "dow", "doy")}
        | {
            "f_second": (F.datepart("second", T), "CAST(floor(date_part('second', ts)) AS DOUBLE)"), "f_epoch": (F.round(F.date_part("epoch", T), 3), "round(epoch(ts), 3)"),
            "f_millisecond": (F.date_part("millisecond", T), "CAST(epoch_us(ts) % 60000000 // 1000 AS DOUBLE)"), "f_microsecond": (F.date_part("microsecond", T), "CAST(epoch_us(ts) % 60000000 AS DOUBLE)"),
            "f_trunc": (F.date_trunc("month", T).cast("timestamp_ntz"), "CAST(date_trunc('month', ts) AS TIMESTAMP)"), "f_trunc_week": (F.datetrunc("week", T).cast("timestamp_ntz"), "CAST(date_trunc('week', ts) AS TIMESTAMP)"),
            "f_bin": (F.date_bin("15 minutes", T).cast("timestamp_ntz"), "time_bucket(INTERVAL 15 MINUTE, ts, TIMESTAMP '1970-01-01')"), "f_bin_from": (F.date_bin("7 hours", T, S.lit("2001-01-01 02:00:00").cast("timestamp")).cast("timestamp_ntz"), "time_bucket(INTERVAL 7 HOUR, ts, TIMESTAMP '2001-01-01 02:00:00')"),
            "f_make_date": (F.make_date(2020, 1, (K % 28 + 1).cast("int")), "make_date(2020, 1, event_id % 28 + 1)"), "f_from_unixtime": (F.from_unixtime(K).cast("timestamp_ntz"), "make_timestamp(event_id * 1000000)"),
            "f_to_unixtime": (F.to_unixtime(T), "CAST(floor(epoch(ts)) AS BIGINT)"), "f_to_timestamp": (F.to_timestamp(F.concat("2020-03-04T05:06:", F.lpad((K % 60).cast(str), 2, "0"))).cast("timestamp_ntz"), "make_timestamp(2020, 3, 4, 5, 6, event_id % 60)"),
            "f_to_timestamp_fmt": (F.to_timestamp(F.concat("04/03/2020 ", F.lpad((K % 24).cast(str), 2, "0")), "%Y-%m-%d", "%d/%m/%Y %H").cast("timestamp_ntz"), "make_timestamp(2020, 3, 4, event_id % 24, 0, 0)"),
            "f_to_timestamp_s": (F.to_timestamp(K * 100000).cast("timestamp_ntz"), "make_timestamp(event_id * 100000 * 1000000)"), "f_seconds": (F.to_timestamp_seconds(K * 100000).cast("timestamp_ntz"), "make_timestamp(event_id * 100000 * 1000000)"),
            "f_millis": (F.to_timestamp_millis(K * 100000).cast("timestamp_ntz"), "make_timestamp(event_id * 100000 * 1000)"), "f_micros": (F.to_timestamp_micros(K * 100000).cast("timestamp_ntz"), "make_timestamp(event_id * 100000)"),
            "f_nanos": (F.to_timestamp_nanos(K * 100000).cast("timestamp_ntz"), "make_timestamp(event_id * 100)"),
        },
    )
    family("fn_volatile", "region", "r_regionkey", {n: (e, None) for n, e in {"f_now": F.now(), "f_current_date": F.current_date(), "f_current_time": F.current_time(), "f_random": F.random(), "f_uuid": F.uuid()}.items()})

    A = col("parent_shas")
    X = F.make_array(K % 3, K % 4, None, K % 3, lit(7).cast("bigint"))
    _X = "[event_id % 3, event_id % 4, NULL, event_id % 3, 7]"
    Y = F.array(lit(1).cast("bigint"), lit(3).cast("bigint"))
    _Y = "[1, 3]::BIGINT[]"
    Z = lit(1).cast("bigint")


    def joined(a):
        """An array of numbers as text, so that both sides compare alike; nulls as n."""
        return F.array_to_string(S.transform(a.column, lambda x: S.coalesce(x.cast("string"), S.lit("n"))), ",")


    def _j(a: str) -> str:
        return f"array_to_string(list_transform({a}, lambda x: coalesce(CAST(x AS VARCHAR), 'n')), ',')"


    family(
        "fn_array_build", "events", "event_id",
        {
            "f_make": (joined(X), _j(_X)), "f_range": (joined(F.range(0, K % 6)), _j("range(0, event_id % 6)")), "f_range_step": (joined(F.range(10, K % 5, -2)), _j("range(10, event_id % 5, -2)")),
            "f_append": (joined(F.array_append(X, K)), _j(f"list_append({_X}, event_id)")), "f_push_back": (joined(F.array_push_back(X, K)), _j(f"list_append({_X}, event_id)")), "f_list_append": (joined(F.list_append(X, K)), _j(f"list_append({_X}, event_id)")),
            "f_list_push_back": (joined(F.list_push_back(X, K)), _j(f"list_append({_X}, event_id)")), "f_prepend": (joined(F.array_prepend(K, X)), _j(f"list_prepend(event_id, {_X})")), "f_push_front": (joined(F.array_push_front(K, X)), _j(f"list_prepend(event_id, {_X})")),
            "f_list_prepend": (joined(F.list_prepend(K, X)), _j(f"list_prepend(event_id, {_X})")), "f_list_push_front": (joined(F.list_push_front(K, X)), _j(f"list_prepend(event_id, {_X})")), "f_concat": (joined(F.array_concat(X, Y)), _j(f"list_concat({_X}, {_Y})")),
            "f_cat": (joined(F.array_cat(Y, X)), _j(f"list_concat({_Y}, {_X})")), "f_repeat": (joined(F.array_repeat(K, 3)), _j("[event_id, event_id, event_id]")), "f_resize": (joined(F.array_resize(X, 7, K)), _j(f"list_resize({_X}, 7, event_id)")),
            "f_list_resize": (joined(F.list_resize(X, 2, K)), _j(f"list_resize({_X}, 2, event_id)")), "f_flatten": (joined(F.flatten(F.make_array(X, Y))), _j(f"flatten([{_X}, {_Y}])")),
            "f_to_string": (F.array_to_string(X, "-"), f"array_to_string({_X}, '-')"), "f_array_join": (F.array_join(X, "-"), f"array_to_string({_X}, '-')"), "f_list_to_string": (F.list_to_string(X, "-"), f"array_to_string({_X}, '-')"), "f_list_join": (F.list_join(X, "-"), f"array_to_string({_X}, '-')"),
        },
    )
    family(
        "fn_array_read", "events", "event_id",
        {
            "f_element": (F.array_element(X, 2), f"({_X})[2]"), "f_extract": (F.array_extract(X, -1), f"({_X})[-1]"), "f_list_element": (F.list_element(X, 9), f"({_X})[9]"), "f_list_extract": (F.list_extract(X, 1), f"({_X})[1]"),
            "f_length": (F.array_length(X), f"len({_X})"), "f_list_length": (F.list_length(Y), f"len({_Y})"), "f_has": (F.array_has(Y, K % 4), f"list_contains({_Y}, event_id % 4)"), "f_has_all": (F.array_has_all(X, Y), f"list_has_all({_X}, {_Y})"),
            "f_has_any": (F.array_has_any(X, Y), f"list_has_any({_X}, {_Y})"), "f_position": (F.array_position(X, Z), f"nullif(list_position({_X}, 1), 0)::BIGINT"), "f_indexof": (F.array_indexof(X, Z), f"nullif(list_position({_X}, 1), 0)::BIGINT"),
            "f_list_position": (F.list_position(X, Z, 2), f"CASE WHEN list_position(({_X})[2:], 1) > 0 THEN list_position(({_X})[2:], 1) + 1 END::BIGINT"), "f_list_indexof": (F.list_indexof(X, Z), f"nullif(list_position({_X}, 1), 0)::BIGINT"),
            "f_positions": (joined(F.array_positions(X, K % 3)), _j(f"list_filter(list_transform({_X}, lambda x, i: CASE WHEN x = event_id % 3 THEN i END), lambda x: x IS NOT NULL)")), "f_list_positions": (joined(F.list_positions(Y, Z)), "'1'"),
            "f_ndims": (F.array_ndims(F.make_array(X, Y)), "CAST(2 AS BIGINT)"), "f_list_ndims": (F.list_ndims(X), "CAST(1 AS BIGINT)"), "f_dims": (joined(F.array_dims(F.make_array(X, X))), "'2,5'"), "f_list_dims": (joined(F.list_dims(X)), "'5'"),
            "f_slice": (joined(F.array_slice(X, 2, 4)), _j(f"({_X})[2:4]")), "f_list_slice": (joined(F.list_slice(X, 1, 5, 2)), _j(f"({_X})[1:5:2]")), "f_slice_neg": (joined(F.array_slice(X, -3, -2)), _j(f"({_X})[-3:-2]")),
            "f_item": (X[1], f"({_X})[2]"),
        },
    )
    _FIRST = "CASE WHEN list_position({a}, 1) > 0 THEN list_concat(({a})[:list_position({a}, 1) - 1], {m}, ({a})[list_position({a}, 1) + 1:]) ELSE {a} END"
    family(
        "fn_array_change", "events", "event_id",
        {
            "f_distinct": (joined(F.array_sort(F.array_distinct(Y))), _j(_Y)), "f_list_distinct": (F.array_length(F.list_distinct(X)), f"len(list_distinct({_X})) + 1"), "f_pop_back": (joined(F.array_pop_back(X)), _j(f"({_X})[:4]")), "f_pop_front": (joined(F.array_pop_front(X)), _j(f"({_X})[2:]")),
            "f_remove": (joined(F.array_remove(X, Z)), _j(_FIRST.format(a=_X, m="[]::BIGINT[]"))), "f_list_remove": (joined(F.list_remove(X, Z)), _j(_FIRST.format(a=_X, m="[]::BIGINT[]"))),
            "f_remove_n": (joined(F.array_remove_n(X, K % 3, 9)), _j(f"list_filter({_X}, lambda x: x IS NULL OR x <> event_id % 3)")), "f_list_remove_n": (joined(F.list_remove_n(X, Z, 1)), _j(_FIRST.format(a=_X, m="[]::BIGINT[]"))),
            "f_remove_all": (joined(F.array_remove_all(X, K % 3)), _j(f"list_filter({_X}, lambda x: x IS NULL OR x <> event_id % 3)")), "f_list_remove_all": (joined(F.list_remove_all(X, Z)), _j(f"list_filter({_X}, lambda x: x IS NULL OR x <> 1)")),
            "f_replace": (joined(F.array_replace(X, Z, K)), _j(_FIRST.format(a=_X, m="[event_id]"))), "f_list_replace": (joined(F.list_replace(X, Z, K)), _j(_FIRST.format(a=_X, m="[event_id]"))), "f_replace_n": (joined(F.array_replace_n(X, Z, K, 1)), _j(_FIRST.format(a=_X, m="[event_id]"))),
            "f_list_replace_n": (joined(F.list_replace_n(X, Z, K, 9)), _j(f"list_transform({_X}, lambda x: CASE WHEN x = 1 THEN event_id ELSE x END)")), "f_replace_all": (joined(F.array_replace_all(X, Z, K)), _j(f"list_transform({_X}, lambda x: CASE WHEN x = 1 THEN event_id ELSE x END)")),
            "f_list_replace_all": (joined(F.list_replace_all(X, Z, K)), _j(f"list_transform({_X}, lambda x: CASE WHEN x = 1 THEN event_id ELSE x END)")), "f_sort": (joined(F.array_sort(X)), _j(f"list_sort({_X}, 'ASC', 'NULLS LAST')")),
            "f_list_sort": (joined(F.list_sort(X, descending=True, null_first=True)), _j(f"list_sort({_X}, 'DESC', 'NULLS FIRST')")), "f_intersect": (joined(F.array_sort(F.array_intersect(X, Y))), _j(f"list_sort(list_filter({_Y}, lambda y: list_contains({_X}, y)))")),
            "f_list_intersect": (joined(F.array_sort(F.list_intersect(Y, X))), _j(f"list_sort(list_filter({_Y}, lambda y: list_contains({_X}, y)))")), "f_union": (joined(F.array_sort(F.array_union(Y, F.make_array(K % 4)))), _j(f"list_sort(list_distinct(list_concat({_Y}, [event_id % 4])))")),
            "f_list_union": (joined(F.array_sort(F.list_union(Y, Y))), _j(_Y)), "f_except": (joined(F.array_except(Y, X)), _j(f"list_filter({_Y}, lambda y: NOT list_contains({_X}, y))")), "f_list_except": (joined(F.list_except(Y, X)), _j(f"list_filter({_Y}, lambda y: NOT list_contains({_X}, y))")),
        },
    )
    family(
        "fn_struct", "nation", "n_nationkey",
        {
            "f_struct": (F.struct(col("n_name"), col("n_regionkey"))["c0"], "n_name"), "f_named": (F.named_struct([("a", col("n_name")), ("b", col("n_regionkey"))])["b"], "n_regionkey"), "f_typeof": (F.arrow_typeof(col("n_name")), "'Utf8'"),
            "f_typeof_int": (F.arrow_typeof(col("n_regionkey")), "'Int32'"), "f_typeof_double": (F.arrow_typeof(lit(1.5)), "'Float64'"),
        },
    )
    return out


@cache
def _real() -> dict[str, Any]:
    from pyspark.sql import functions as S

    from millrace import functions as F
    from millrace.expr import col, lit

    return families(F, S, col, lit)


def _query(name: str) -> Query:
    def run(spark, d):
        source, key, calls = _real()[name]
        return frame(spark, d, source).select(key, *[e.alias(n) for n, (e, _) in calls.items()]).df

    run.__name__ = name
    return run


_PLAIN = families(*[_Nothing()] * 4)
QUERIES: dict[str, Query] = {name: _query(name) for name in _PLAIN}
SQL: dict[str, str] = {
    name: f"SELECT {key}, " + ", ".join(f"{q} AS {n}" for n, (_, q) in calls.items()) + f" FROM {source}"
    for name, (source, key, calls) in _PLAIN.items()
    if all(q is not None for _, q in calls.values())
}
