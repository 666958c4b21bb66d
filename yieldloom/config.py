"""Constants that are part of the results."""

# Fixed values.
CUTOFF_HOUR = 7
UNBOUNDED = 999_999
SAVE_RATE = 0.86
METADATA = ("SN", "Time", "Line", "Project", "Vendor", "Yield3")
REQUIRED_METADATA = ("Vendor", "Project", "Line")
MIGRATION_FILL = {"Project": "967E1", "Vendor": "LY"}
REPAIRABLE = (
    "FAI312", "FAI313", "FAI314", "FAI315", "FAI316", "FAI317", "FAI318", "FAI319", "FAI320", "FAI321",
    "FAI322", "FAI323", "FAI324", "FAI325", "FAI326", "FAI327", "FAI344", "FAI346", "FAI347", "FAI348",
)
HEADER_ALIASES = {
    "SN": ("SN", "FG号", "序列号", "ProductSN", "SerialNumber"),
    "Time": ("Time", "检测时间", "测量时间", "测试时间", "TestTime", "Timestamp"),
    "Project": ("Project", "项目", "项目代号", "ProductCode", "Project Code", "ProjectName", "Yield1"),
    "Vendor": ("Vendor", "供应商", "Vendor Code", "VendorName", "Yield2"),
    "Line": ("Line", "线体", "产线", "CFG", "LineName", "ProductionLine"),
}
UNKNOWN, OTHERS = "未知", "其他"

RESULT, OVERALL = "_result", "overall_result"
CORE = ("SN", "Line", "Time", "Project", "Vendor", "Yield3", OVERALL)
#: Columns that give an imported row's place: its file, the byte range that it begins in, and its number there.
PLACE = ("__file", "__range", "__row")
