"""Small files the source tests read."""

HEAD = '"Region","Sex","Age","Number of years in Sweden","Region of birth","Observations","Year","Value"'


def statistics_file(folder, lines, name="stat.csv", encoding="ISO-8859-1"):
    path = folder / name
    path.write_bytes("\n".join([HEAD, *lines]).encode(encoding))
    return str(path)


def line(label, year, value, observation="Employment rate, %", region="00 Sweden", sex="Total", age="20-64 years", stay="Total"):
    return ",".join(f'"{v}"' for v in (region, sex, age, stay, label, observation, year, value))


def table(df):
    return {tuple(r)[:-1]: tuple(r)[-1] for r in df.collect()}
