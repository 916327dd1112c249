"""Both file layouts, sheets and payloads to canonical rows."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tidemark.sources import market

OLD = "INSTRUMENT,SYMBOL,EXPIRY_DT,STRIKE_PR,OPTION_TYP,OPEN,HIGH,LOW,CLOSE,SETTLE_PR,CONTRACTS,VAL_INLAKH,OPEN_INT,CHG_IN_OI,TIMESTAMP,"
NEW = "TradDt,FinInstrmTp,TckrSymb,XpryDt,FininstrmActlXpryDt,StrkPric,OptnTp,OpnPric,HghPric,LwPric,ClsPric,UndrlygPric,SttlmPric,OpnIntrst,TtlTradgVol"


def old_file(folder, header=OLD):
    rows = [
        "FUTIDX,IDX ,30-OCT-2008,0,XX,1,2,3,4,5,100,0,7,0,24-OCT-2008,",
        "OPTIDX,IDX,30-OCT-2008,2500,CE,1,2,3,4,5,10,0,7,0,24-OCT-2008,",
        "OPTIDX,IDX,30-OCT-2008,2500,CE,0,0,0,0,0,0,0,0,0,24-OCT-2008,",
        "OPTIDX,IDX,30-OCT-2008,2500,PE,1,2,3,4,6,11,0,7,0,24-OCT-2008,",
        "OPTSTK,IDX,30-OCT-2008,10,PE,1,2,3,4,6,11,0,7,0,24-OCT-2008,",
        "OPTIDX,OTHER,30-OCT-2008,10,PE,1,2,3,4,6,11,0,7,0,24-OCT-2008,",
    ]
    path = folder / "old.csv"
    path.write_text("\n".join([header, *rows]))
    return str(path)


def test_panel_of_both_layouts(spark, tmp_path):
    new = tmp_path / "new.csv"
    new.write_text("\n".join([NEW, "2025-09-02,IDF,IDX,2025-09-25,2025-09-30,,,1,2,3,4,24000,5,6,7", "2025-09-02,IDO,IDX,2025-09-25,2025-09-30,24000,CE,1,2,3,4,24000,5,6,7"]))
    got = market.build_panel(spark, [old_file(tmp_path), str(new)], "IDX")
    assert got.columns == market.COLUMNS
    rows = {(r.date.year, r.instrument, r.strike, r.opt_type): r for r in got.collect()}
    assert set(rows) == {(2008, "FUT", None, None), (2008, "OPT", 2500.0, "CE"), (2008, "OPT", 2500.0, "PE"), (2025, "FUT", None, None), (2025, "OPT", 24000.0, "CE")}
    assert rows[2008, "OPT", 2500.0, "CE"].volume == 10 and rows[2025, "FUT", None, None].expiry == dt.date(2025, 9, 30)
    assert rows[2025, "FUT", None, None].underlying == 24000 and rows[2008, "FUT", None, None].underlying is None


def test_synonym_header_and_wrong_date(spark, tmp_path):
    path = old_file(tmp_path, OLD.replace("OPTION_TYP", "OPTIONTYPE"))
    raw = market.keep_symbol(spark.read.option("header", True).csv(path), "IDX")
    assert market.normalize(raw, F.lit("2008-10-24").cast("date")).count() == 3
    with pytest.raises(Exception, match="another date"):
        market.normalize(raw, F.lit("2008-10-25").cast("date")).collect()
    with pytest.raises(ValueError, match="lacks"):
        market.normalize(raw.drop("CLOSE"))
    assert market.build_panel(spark, [], "IDX").count() == 0


def test_series_and_auctions(spark):
    payload = '[{"Date": "01 Jan 2001", "Close": "-"}, {"Date": "02 Jan 2001", "Close": "279.02"}, {"Date": "02 Jan 2001", "Close": "279.02"}]'
    got = market.index_series(spark.createDataFrame([(payload,)], "p string"), "p", "Date", "Close").orderBy("date").collect()
    assert [(r.date.day, r.value) for r in got] == [(1, None), (2, 279.02)]
    cells = [("s", 1, 0, "Notes"), ("s", 2, 0, "Date of Auction"), ("s", 2, 1, "Yield"), ("s", 3, 0, "05-Jan-2001"), ("s", 3, 1, "7.332"), ("s", 4, 0, "source: x"), ("s", 4, 1, "n/a")]
    sheet = market.auctions_from_sheets(spark.createDataFrame(cells, "sheet string, row int, col int, val string"), {"date": "date of auction", "yield_pct": "yield"})
    assert [(r.date, r.yield_pct) for r in sheet.collect()] == [(dt.date(2001, 1, 5), 7.332)]
    html = '<script>x = "[{\\"date\\":\\"2001-01-05\\",\\"tenor\\":\\"91\\",\\"yield\\":\\"7.2\\"},{\\"date\\":\\"2001-01-05\\",\\"tenor\\":\\"182\\",\\"yield\\":\\"7.9\\"},{\\"date\\":\\"2001-01-12\\",\\"tenor\\":\\"91\\",\\"yield\\":\\"7.18\\"}]"</script>'
    page = market.auctions_from_html(spark.createDataFrame([(html,)], "h string"), "h")
    both = market.stitch({"page": page, "sheet": sheet}).orderBy("date").collect()
    assert [(r.yield_pct, r.source) for r in both] == [(7.2, "page"), (7.18, "page")]
