"""SQL of the canonical form of an id, for the side-by-side comparison of results."""

_CANON = r"""CASE WHEN regexp_full_match(regexp_replace(lower(trim({0}, ' \t\r\n')), '^urn:uuid:|[{{}}-]', '', 'g'), '[0-9a-f]{{32}}')
 THEN regexp_replace(regexp_replace(lower(trim({0}, ' \t\r\n')), '^urn:uuid:|[{{}}-]', '', 'g'), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '\1-\2-\3-\4-\5')
 ELSE lower(trim({0}, ' \t\r\n')) END""".replace(r"\t\r\n", "")


def canon_sql(expression: str) -> str:
    """SQL of the canonical form of an id."""
    return _CANON.format(expression)
