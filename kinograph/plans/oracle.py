"""SQL fragments that the oracles share: the embeddings table as pixels and gradients."""

WHOLE = "len(embedding) = 64"
#: v at pixel (y, x) of frame t of a clip.
PX = f"""px AS (SELECT label::BIGINT AS clip, vec_id AS t, ((i - 1) // 8)::BIGINT AS y, ((i - 1) % 8)::BIGINT AS x, i::INT AS i,
  embedding[i]::DOUBLE AS v FROM embeddings, range(1, 65) r(i) WHERE {WHOLE})"""
#: and its gradients, one-sided at borders.
GR = f"""gr AS (SELECT label::BIGINT AS clip, vec_id AS t, ((i - 1) // 8)::BIGINT AS y, ((i - 1) % 8)::BIGINT AS x, embedding[i]::DOUBLE AS v,
  (embedding[CASE WHEN (i - 1) % 8 < 7 THEN i + 1 ELSE i END]::DOUBLE - embedding[CASE WHEN (i - 1) % 8 > 0 THEN i - 1 ELSE i END]::DOUBLE)
    / (CASE WHEN (i - 1) % 8 IN (0, 7) THEN 1 ELSE 2 END) AS dx,
  (embedding[CASE WHEN i <= 56 THEN i + 8 ELSE i END]::DOUBLE - embedding[CASE WHEN i > 8 THEN i - 8 ELSE i END]::DOUBLE)
    / (CASE WHEN i > 56 OR i <= 8 THEN 1 ELSE 2 END) AS dy
  FROM embeddings, range(1, 65) r(i) WHERE {WHOLE})"""


def mirrored(kernel: list, source: str = "embedding") -> str:
    """A weighted neighbourhood sum at position i (1 to 64), borders mirrored."""
    r, terms = len(kernel) // 2, []

    def axis(value: str, d: int) -> str:
        return f"(CASE WHEN {value} + {d} < 0 THEN -({value} + {d}) WHEN {value} + {d} > 7 THEN 14 - ({value} + {d}) ELSE {value} + {d} END)"

    for dy, row in enumerate(kernel):
        for dx, k in enumerate(row):
            if k:
                at = f"{axis('((i - 1) // 8)', dy - r)} * 8 + {axis('((i - 1) % 8)', dx - r)} + 1"
                terms.append(f"{source}[({at})::INT]::DOUBLE * ({k})")
    return " + ".join(terms)
