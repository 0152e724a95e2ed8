"""Deeply nested semi-structured records to related flat tables.

Every payload is parsed once into a VARIANT. Nested ``transform`` calls walk it level by level and
attach the ancestor keys and the 1-based position in the written list, ``flatten`` joins the arrays of
one level, and one ``inline`` per target table emits the rows. There is no shuffle and no Python: one
record is one task-local expression, so neither size nor skew of ids matters.

Irregular shapes that are understood: a payload that is the document itself, wraps it (``document``) or
wraps several (``batch.documents``); a list written as a lone object (position 1), as a JSON string, as
``{"items": [...]}``, or as null (no rows); null list elements (they count as positions, but give no
row); candidates written as a map from entity id to the rest (positions as the keys stand in the payload); tokens
written as ``[text, start, end]``; support ids written as objects with ``triple_id`` or as
one string joined by ``|``; mentions beside the sentences, with their own ``sentence_id``.

Defined results: null, empty, cut off or otherwise invalid payloads give no rows; links without a parent or child id
give no rows; a null ``raw_id`` is kept as null; other columns of the input are ignored.
"""

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One target table each.
KINDS = ("sentence", "token", "mention", "candidate", "triple", "support")


def _valid(payload: str) -> str:
    """The root as VARIANT, or null. Two different wrappings must parse: the parser alone ignores what follows the first value."""
    listed = f"try_cast(try_parse_json(concat('[', {payload}, ']')) AS array<variant>)"
    return f"CASE WHEN size({listed}) = 1 AND try_parse_json(concat('{{\"p\":', {payload}, '}}')) IS NOT NULL THEN {listed}[0] END"


_names = count()


def _let(value: str, body) -> str:
    """``body`` of a value that is computed once, bound to a lambda variable."""
    x = f"v{next(_names)}"
    return f"transform(array({value}), {x} -> {body(x)})[0]"


NONE = "cast(array() AS array<variant>)"


def _list(v: str) -> str:
    """Any way of writing a list, as array<variant>; what is missing is an empty list."""
    listed = lambda x: f"try_cast({x} AS array<variant>)"
    lone = lambda x: f"coalesce({listed(x)}, CASE WHEN startswith(schema_of_variant({x}), 'OBJECT') THEN array({x}) END, {NONE})"
    body = lambda x, kind: (
        f"CASE WHEN {kind} IS NULL OR {kind} = 'VOID' THEN {NONE} WHEN startswith({kind}, 'ARRAY') THEN {listed(x)} "
        f"WHEN {kind} = 'STRING' THEN {_let(f'try_parse_json(try_cast({x} AS string))', lone)} "
        f"WHEN startswith({kind}, 'OBJECT') THEN coalesce(try_variant_get({x}, '$.items', 'array<variant>'), array({x})) ELSE array({x}) END"
    )
    return _let(v, lambda x: _let(f"schema_of_variant({x})", lambda kind: body(x, kind)))


def _text(v: str, path: str) -> str:
    return f"try_variant_get({v}, '{path}', 'string')"


def _sub(v: str, path: str) -> str:
    return f"try_variant_get({v}, '{path}', 'variant')"


def _links(kind: str, items: str, parent: str, child) -> str:
    """array<link> of one list: position and child id of each element that isn't null."""
    return f"transform({items}, (e, i) -> named_struct('child_kind', '{kind}', 'parent_id', {parent}, 'child_no', cast(i + 1 AS bigint), 'child_id', {child('e')}))"


def _candidates(v: str, parent: str) -> str:
    """array<link> of a mention's candidates, a list written in any way or a map by entity id. A VARIANT forgets the order of keys, so they are looked up in the payload behind the mention's id."""
    start = f"greatest(locate('\"candidates\"', `_payload`, greatest(locate(concat('\"', {parent}, '\"'), `_payload`), 1)), 1)"
    link = "named_struct('child_kind', 'candidate', 'parent_id', {p}, 'child_no', cast(i + 1 AS bigint), 'child_id', {c})"
    ordered = lambda m, at: f"array_sort(transform(map_entries({m}), y -> named_struct('at', locate(concat('\"', y.key, '\"'), `_payload`, {at}), 'key', y.key, 'there', y.value IS NOT NULL)))"
    rows = lambda m: _let(start, lambda at: f"transform({ordered(m, at)}, (y, i) -> {link.format(p=parent, c='CASE WHEN y.there THEN y.key END')})")
    keyed = lambda x: f"startswith(schema_of_variant({x}), 'OBJECT') AND {_text(x, '$.entity_id')} IS NULL AND {_sub(x, '$.items')} IS NULL"
    as_map = lambda x: _let(f"from_json(to_json({x}), 'map<string, string>')", rows)
    return _let(v, lambda x: f"CASE WHEN {keyed(x)} THEN {as_map(x)} ELSE {_links('candidate', _list(x), parent, lambda e: _text(e, '$.entity_id'))} END")


def nested_links(df: DataFrame, key: str = "raw_id", payload: str = "payload") -> dict[str, DataFrame]:
    """The flat link tables of nested payloads: ``{kind: (key, child_kind, parent_id, child_no, child_id)}``."""
    parsed = _arrays(df, key, payload)
    return {k: _emit(parsed, key, [k]) for k in KINDS}


def all_links(df: DataFrame, key: str = "raw_id", payload: str = "payload") -> DataFrame:
    """All link tables in one: each payload is parsed once and emitted by a single ``inline``."""
    return _emit(_arrays(df, key, payload), key, KINDS)


def _emit(parsed: DataFrame, key: str, kinds) -> DataFrame:
    arrays = ", ".join(f"a_{k}" for k in kinds)
    rows = parsed.selectExpr("`_key`", f"inline(filter(concat({arrays}), x -> x.parent_id IS NOT NULL AND x.child_id IS NOT NULL))")
    return rows.withColumnRenamed("_key", key)


def _arrays(df: DataFrame, key: str, payload: str) -> DataFrame:
    d = df.select(F.col(key).alias("_key"), F.col(payload).alias("_payload"), F.expr(_valid(f"`{payload}`")).alias("root")).where("root IS NOT NULL AND startswith(schema_of_variant(root), 'OBJECT')")
    roots = f"""flatten(array(
        {_list(_sub('root', '$.batch.documents'))},
        {_list(_sub('root', '$.document'))},
        CASE WHEN {_text('root', '$.document_id')} IS NOT NULL THEN array(root) ELSE cast(array() AS array<variant>) END))"""
    d = d.selectExpr("_key", "_payload", f"transform({roots}, d -> named_struct('id', {_text('d', '$.document_id')}, 'sentences', {_list(_sub('d', '$.sentences'))}, 'mentions', {_list(_sub('d', '$.mentions'))}, 'triples', {_list(_sub('d', '$.triples'))})) AS docs")
    within = lambda what: f"flatten(transform(docs, d -> transform(d.sentences, s -> named_struct('parent', {_text('s', '$.sentence_id')}, 'items', {_list(_sub('s', '$.' + what))}))))"
    beside = f"flatten(transform(docs, d -> transform(d.mentions, (m, i) -> named_struct('parent', {_text('m', '$.sentence_id')}, 'no', cast(i + 1 AS bigint), 'm', m))))"
    nested = "flatten(transform(mention_lists, l -> transform(l.items, (m, i) -> named_struct('parent', l.parent, 'no', cast(i + 1 AS bigint), 'm', m))))"
    d = d.selectExpr("_key", "_payload", "docs", f"{within('tokens')} AS token_lists", f"{within('mentions')} AS mention_lists")
    d = d.selectExpr(
        "_key", "_payload", "docs", "token_lists", f"concat({nested}, {beside}) AS mentions",
        f"flatten(transform(docs, d -> transform(d.triples, t -> named_struct('parent', {_text('t', '$.triple_id')}, 'items', {_supports(_sub('t', '$.support_triple_ids'))})))) AS support_lists",
    )
    token = lambda e: f"coalesce({_text(e, '$.text')}, {_text(e, '$[0]')}, CASE WHEN schema_of_variant({e}) = 'STRING' THEN try_cast({e} AS string) END)"
    support = lambda e: f"coalesce({_text(e, '$.triple_id')}, CASE WHEN schema_of_variant({e}) = 'STRING' THEN try_cast({e} AS string) END)"
    return d.selectExpr(
        "_key",
        f"flatten(transform(docs, d -> {_links('sentence', 'd.sentences', 'd.id', lambda e: _text(e, '$.sentence_id'))})) AS a_sentence",
        f"flatten(transform(token_lists, l -> {_links('token', 'l.items', 'l.parent', token)})) AS a_token",
        f"transform(mentions, x -> named_struct('child_kind', 'mention', 'parent_id', x.parent, 'child_no', x.no, 'child_id', {_text('x.m', '$.mention_id')})) AS a_mention",
        f"flatten(transform(mentions, x -> {_let(_text('x.m', '$.mention_id'), lambda p: _candidates(_sub('x.m', '$.candidates'), p))})) AS a_candidate",
        f"flatten(transform(docs, d -> {_links('triple', 'd.triples', 'd.id', lambda e: _text(e, '$.triple_id'))})) AS a_triple",
        f"flatten(transform(support_lists, l -> {_links('support', 'l.items', 'l.parent', support)})) AS a_support",
    )


def _supports(v: str) -> str:
    """As ``_list``, where a string that is no JSON list holds ids joined by ``|``."""
    ids = lambda x: f"transform(filter(split({x}, '[|]'), y -> trim(y) <> ''), y -> to_variant_object(named_struct('triple_id', trim(y))))"
    plain = lambda x: f"CASE WHEN schema_of_variant({x}) = 'STRING' AND NOT startswith(trim(try_cast({x} AS string)), '[') THEN {ids(f'try_cast({x} AS string)')} ELSE {_list(x)} END"
    return _let(v, plain)


def p2_found(spark, directory: str) -> DataFrame:
    from ..sources.tables import table

    return all_links(table(spark, directory, "raw_records")).distinct()
