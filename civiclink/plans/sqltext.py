"""SQL fragments for the twins: the text rules spelled out for the other engine."""


def fold(x: str) -> str:
    return f"strip_accents(coalesce({x}, ''))"


def collapse(x: str) -> str:
    return f"trim(regexp_replace(coalesce({x}, ''), '[\\s]+', ' ', 'g'))"


def upper(x: str) -> str:
    return f"upper(replace({x}, 'ß', 'SS'))"


def words(x: str) -> str:
    return collapse(f"regexp_replace({x}, '[^\\pL\\pN_\\s]+', ' ', 'g')")


def unmark(x: str) -> str:
    return f"translate(regexp_replace(trim({x}), '^[\\s\\-–—•*]+', ''), '-/', '  ')"


def match_key(x: str) -> str:
    return words(fold(unmark(upper(f"coalesce({x}, '')"))))


def query_key(x: str) -> str:
    return words(unmark(upper(fold(x))))


def slug(x: str, folded: bool = True) -> str:
    text = f"lower({fold(x)})" if folded else f"lower(trim(coalesce({x}, '')))"
    body = f"trim(regexp_replace({text}, '[^a-z0-9]+', '_', 'g'), '_')"
    return f"substr(CASE WHEN {body} = '' THEN 'item' ELSE {body} END, 1, 80)"


def pad(x: str, n: int = 7) -> str:
    return f"CASE WHEN length({x}) < {n} THEN lpad({x}, {n}, '0') ELSE {x} END"


def lcs(a: str, b: str) -> str:
    """Longest common subsequence: the rows of the dynamic table as a list fold."""
    return (
        f"list_reduce(list_transform(string_split({a}, ''), lambda ch: [ord(ch)]), lambda prev, ch:"
        f" list_reduce(list_transform(range(1, length({b}) + 1), lambda j: [CAST(j AS INT)]), lambda acc, j:"
        f" list_append(acc, greatest(acc[-1], CASE WHEN ord(substr({b}, j[1], 1)) = ch[1]"
        " THEN prev[j[1]] + 1 ELSE prev[j[1] + 1] END)), [0]),"
        f" list_resize([0], length({b}) + 1, 0))[-1]"
    )


def origin(u: str) -> str:
    return f"regexp_extract({u}, '^([a-z]+://[^/?#]*)', 1)"
