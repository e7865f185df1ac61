"""Accuracy and macro-F1 by their definitions."""


def metrics(pairs):
    classes = sorted({x for p in pairs for x in p})
    f1 = []
    for c in classes:
        hit = sum(a == b == c for a, b in pairs)
        both = sum(a == c for a, _ in pairs) + sum(b == c for _, b in pairs)
        f1.append(2 * hit / both if both else 0.0)
    return sum(a == b for a, b in pairs) / len(pairs), sum(f1) / len(f1)
