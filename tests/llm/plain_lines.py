"""Line dedup in plain code."""


def runs(lines, min_lines=3, long_chars=40):
    """Start and lines of every run that is judged."""
    for n in range(1, min_lines + 1):
        for s in range(len(lines) - n + 1):
            run = lines[s:s + n]
            if any(len(x.strip(" ")) >= (1 if n == min_lines else long_chars) for x in run):
                yield s, tuple(run)


def gone_lines(documents, **limits):
    """For each (place, text) the indices of the lines that go."""
    split = [(d, [] if t is None else t.split("\n")) for d, t in documents]
    first = {}
    for d, lines in split:
        for s, run in runs(lines, **limits):
            first[run] = min(first.get(run, (d, s)), (d, s))
    return [{i for s, run in runs(lines, **limits) if first[run] < (d, s)
             for i in range(s, s + len(run))} for d, lines in split]
