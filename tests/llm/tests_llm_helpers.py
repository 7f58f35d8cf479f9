def rows_of(df):
    return [r.asDict() for r in df.collect()]
