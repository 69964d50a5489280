"""Invented words for the operators' tests."""

WORDS = "the of and tree river über maïs stone lamp wander quiet seven glass ñandu blue mirror paper cloud iron salt".split()


def prose(rnd, n):
    """n invented words, a few of them frequent."""
    return [rnd.choice(WORDS[:3]) if rnd.random() < 0.2 else rnd.choice(WORDS) + str(rnd.randrange(400)) for _ in range(n)]
