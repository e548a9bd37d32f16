"""The rule tables for chemistry papers. All are plain data; see ``functions.rules`` for their meaning."""

from __future__ import annotations

from sievemark.functions.rules import Case, Rule

TOPICS = Rule.of(
    [
        ("化学变化与物理变化", ["化学变化", "物理变化", "化学性质", "物理性质", "燃烧", "烧制"]),
        ("实验安全与基本操作", ["实验室", "安全", "药品", "试剂", "加热", "玻璃棒", "仪器", "量筒", "滴管", "过滤", "蒸发"]),
        ("空气与氧气", ["空气", "氧气", "助燃", "红磷", "氧含量", "氧气含量", "制取氧气", "催化剂", "过氧化氢", "铁丝", "燃烧"]),
        ("水与净化", ["水", "净化", "硬水", "软水", "电解水", "蒸馏", "过滤", "吸附"]),
        ("物质构成与元素", ["分子", "原子", "离子", "元素", "元素周期表", "化学式", "氧化物", "相对原子质量", "质量分数", "微粒"]),
        ("化学用语与化合价", ["化合价", "化学式", "离子符号", "方程式", "质量守恒", "配平", "符号"]),
        ("溶液与溶解度", ["溶液", "溶质", "溶剂", "溶解度", "饱和", "不饱和", "溶质质量分数", "结晶", "曲线"]),
        ("金属与材料", ["金属", "铁", "铜", "铝", "锌", "合金", "生锈", "腐蚀", "置换", "材料"]),
        ("酸碱盐", ["酸", "碱", "盐", "pH", "中和", "氢氧化钠", "盐酸", "硫酸", "碳酸钠", "碳酸盐", "复分解"]),
        ("碳与二氧化碳", ["碳", "二氧化碳", "CO2", "一氧化碳", "碳循环", "温室", "降碳", "气体制取"]),
        ("实验探究与控制变量", ["探究", "控制变量", "对照", "实验方案", "猜想", "现象", "结论", "数字化", "传感器", "异常"]),
        ("工艺流程与推断", ["工艺流程", "推断", "除杂", "鉴别", "框图", "流程图", "分离提纯"]),
        ("化学计算", ["化学计算", "方程式计算", "相对分子质量", "质量分数", "溶质质量分数", "数据处理", "图像计算"]),
        ("化学与生活/能源/化肥", ["化肥", "复合肥", "营养", "钙", "铁", "能源", "燃料", "环保", "跨学科", "航天", "新能源"]),
    ],
    fold=True,
)

#: Signals of a question, and the topic a candidate should have then.
SIGNALS = [
    ("CO2|二氧化碳|降碳|碳循环", "碳与二氧化碳"),
    ("溶解度|溶质质量分数|饱和|结晶", "溶液与溶解度"),
    ("pH|中和|酸|碱|盐酸|氢氧化钠|碳酸盐", "酸碱盐"),
    ("控制变量|对照|探究|猜想|数字化|传感器", "实验探究与控制变量"),
    ("化合价|化学式|相对分子质量|质量分数", "物质构成与元素"),
    ("除杂|鉴别|推断|流程图|工艺流程", "工艺流程与推断"),
]

_CO2, _NAOH = ("二氧化碳", "CO2"), ("氢氧化钠", "NaOH")

VISUAL = [
    *Rule.of(
        [
            ("流程图", ["流程图", "工艺流程", "滤液", "滤渣", "废液", "废渣", "酸浸", "焙烧", "制备", "回收", "提纯"]),
            ("设备流程", ["吸收塔", "合成塔", "反应塔", "气化炉", "变换炉", "设备", "塔", "炉", "容器", "反应器"]),
            ("循环物质", ["可循环", "循环使用", "循环利用", "回收利用", "返回", "再利用"]),
            ("装置图", ["装置", "仪器", "导管", "试管", "烧杯", "集气瓶", "锥形瓶", "U型管", "注射器", "传感器"]),
            ("曲线图", ["曲线", "图像", "坐标", "pH", "溶解度", "纵坐标", "横坐标", "折线"]),
            ("柱状图", ["柱状图", "柱形图", "柱状", "条形图"]),
            ("表格", ["表格", "数据", "记录", "实验次数", "性质", "特点", "反应原理"]),
            ("题组材料", ["回答", "阅读", "资料", "短文", "材料", "题组"]),
            ("框图推断", ["推断", "框图", "转化关系", "A、B", "A～", "甲乙丙"]),
            ("方案设计", ["设计方案", "设计一份", "改进方案", "评价方案", "存在的缺陷", "合理的方案"]),
            ("项目任务链", ["任务一", "任务二", "任务三", "查阅资料", "项目式", "跨学科", "实践活动", "真实情境"]),
            ("数字化曲线", ["数字化", "传感器", "压强传感器", "溶氧量", "随时间变化", "电导率"]),
        ]
    ),
    Rule("CO2-NaOH", (), (_CO2, _NAOH)),
    *Rule.of([("U型管压强", ["U型管", "红墨水", "压强", "液面"])]),
]

METHODS = Rule.of(
    [
        ("控制变量", ["控制变量", "对照实验", "单一变量", "影响因素"]),
        ("排除干扰", ["排除干扰", "干扰因素", "空白实验", "不严谨"]),
        ("异常现象探究", ["异常现象", "反常", "不明显现象", "无明显现象", "可视化"]),
        ("数字化曲线分析", ["数字化", "传感器", "曲线", "压强", "溶氧量", "电导率"]),
        ("实验方案评价", ["方案", "缺陷", "评价", "改进", "可行", "不可行"]),
        ("可循环物质判断", ["可循环", "循环利用", "循环使用", "最终产物", "前面出现"]),
        ("设备流程分析", ["吸收塔", "合成塔", "气化炉", "变换炉", "从.*处通入", "提高吸收效率"]),
        ("图表信息提取", ["结合图", "由图可知", "图像分析", "数据分析", "表中"]),
        ("守恒/方程式计算", ["质量守恒", "化学方程式", "计算", "恰好完全反应"]),
    ]
)

TASK_MODELS = Rule.of(
    [
        ("共存判断", ["大量共存", "能否共存", "不能共存", "可共存", "能共存", "离子共存", "物质共存"]),
        ("除杂判断", ["除杂", "除去杂质", "不引入新杂质", "提纯", "净化"]),
        ("鉴别判断", ["鉴别", "区分", "检验", "鉴定", "分别加入"]),
        ("转化判断", ["一步转化", "转化", "能否反应", "能否实现", "物质间反应"]),
        ("排序判断", ["排序", "由大到小", "由小到大", "活动性", "先后顺序", "反应先后"]),
        ("图像匹配", ["图像", "曲线", "坐标", "纵坐标", "横坐标", "变化趋势"]),
        ("方案评价", ["设计方案", "评价方案", "方案可行", "方案不可行", "缺陷", "改进方案"]),
        ("循环物质判断", ["可循环", "循环利用", "循环使用", "返回", "再利用"]),
        ("入口/出口/步骤作用判断", ["处通入", "入口", "出口", "步骤作用", "提高吸收效率"]),
    ]
)

CORE = [
    *Rule.of(
        [
            ("测定空气中氧气含量", ["氧气含量", "红磷", "白磷", "测定空气"]),
            ("实验室制取气体", ["制取氧气", "制取二氧化碳", "发生装置", "收集装置", "检验二氧化碳"]),
        ]
    ),
    Rule("电解水", ("电解水", "水的电解", "电解", "通电"), (("电解水", "水的电解", "水", "H2O"),), ("锂电池", "锂离子电池", "固态锂电池", "负极材料", "电解质", "比容量", "能量密度")),
    *Rule.of(
        [
            ("燃烧条件", ["燃烧条件", "着火点", "可燃物", "燃烧三要素"]),
            ("金属锈蚀", ["金属锈蚀", "铁生锈", "生锈条件", "锈蚀"]),
            ("催化剂探究", ["催化剂", "催化效果", "过氧化氢分解", "二氧化锰"]),
        ]
    ),
    Rule("NaOH与CO2反应证明", (), (_CO2, _NAOH)),
    *Rule.of([("溶解度曲线", ["溶解度曲线", "饱和溶液", "不饱和溶液", "结晶"])]),
]

BACKGROUND = [
    *Rule.of(
        [
            ("甲醇生产", ["甲醇", "CH3OH", "合成塔", "吸收塔"]),
            ("铝冶炼/含氟烟气回收", ["铝", "HF", "氟", "Na3AlF6", "载氟氧化铝"]),
            ("活鱼运输增氧", ["活鱼", "运输", "增氧", "溶氧量", "鱼类"]),
            ("发酵/有机酸", ["发酵", "黑曲霉", "柠檬酸", "苹果酸", "葡萄糖"]),
        ]
    ),
    Rule("NaOH与CO2", (), (_CO2, _NAOH)),
    *Rule.of([("金属回收", ["金属回收", "废液", "滤渣", "滤液", "回收金属"])]),
]

TASKS = Rule.of(
    [
        ("写方程式", ["化学方程式", "符号表达式"]),
        ("判断入口/操作", ["从", "处通入", "操作名称", "操作为"]),
        ("找循环物质", ["可循环", "循环使用", "循环利用"]),
        ("解释原因", ["原因", "理由", "解释"]),
        ("设计方案", ["设计一份", "设计方案", "方案"]),
        ("信息提取", ["结合图", "由图可知", "资料", "阅读"]),
    ]
)

#: Signatures: each is given by any one of its rules, in this order.
SIGNATURES = [
    Rule("测定空气中氧气含量", ("氧气含量", "测定空气中氧气", "测氧气")),
    Rule("测定空气中氧气含量", ("红磷", "白磷"), (("空气",), ("氧气",))),
    Rule("实验室制取氧气", ("制取氧气", "实验室制氧")),
    Rule("实验室制取氧气", ("过氧化氢", "高锰酸钾", "氯酸钾"), (("氧气",),)),
    Rule("电解水实验", ("电解水",)),
    Rule("电解水实验", ("正极", "负极"), (("氢气", "氧气"), ("水",))),
    Rule("控制变量实验", ("控制变量", "对照实验", "单一变量", "继续实验")),
    Rule("排除干扰因素", ("干扰因素", "排除干扰", "空白实验")),
    Rule("催化剂探究", ("催化剂", "催化效果"), (("速率", "过氧化氢", "分解", "二氧化锰"),)),
    Rule("燃烧条件探究", ("燃烧条件",)),
    Rule("燃烧条件探究", ("可燃物", "着火点"), (("氧气", "空气"),)),
    Rule("溶解度曲线", ("溶解度曲线",)),
    Rule("溶解度曲线", ("溶解度",), (("饱和", "不饱和", "结晶", "温度"),)),
    Rule("溶液稀释与质量分数", ("溶液稀释", "稀释")),
    Rule("溶液稀释与质量分数", ("溶质质量分数",), (("溶液", "溶质", "质量"),)),
    Rule("酸碱中和pH图像", ("pH",), (("中和", "滴加", "酸", "碱", "盐酸", "氢氧化钠"),)),
    Rule("酸碱盐性质探究", ("复分解",)),
    Rule("酸碱盐性质探究", ("酸碱盐",), (("性质", "探究"),)),
    Rule("酸碱盐性质探究", ("沉淀",), (("盐酸", "硫酸", "氢氧化钠", "碳酸钠"),)),
    Rule("碳酸盐鉴别", ("碳酸根", "碳酸氢盐", "碳酸盐"), (("检验", "鉴别", "石灰水", "气体"),)),
    Rule("NaOH与CO2反应探究", _NAOH, (_CO2, ("压强", "U型管", "传感器", "数字化", "反应"))),
    Rule("石灰水与CO2异常", ("石灰水",), (_CO2, ("异常", "沉淀", "碳酸钙"))),
    Rule("金属与酸图像", ("金属与酸", "金属和酸"), (("氢气", "图像", "曲线", "质量"),)),
    Rule("金属与酸图像", ("锌", "铁", "镁", "铝"), (("盐酸", "稀硫酸", "酸"), ("氢气", "图像", "曲线", "质量"))),
    Rule("金属置换先后", ("置换反应", "金属置换")),
    Rule("金属置换先后", ("活动性顺序", "金属活动性"), (("先后", "滤液", "滤渣", "硝酸银", "硫酸铜"),)),
    Rule("金属回收工艺", ("金属回收",)),
    Rule("金属回收工艺", ("回收",), (("金属", "铜", "铁", "锌"), ("流程", "废液", "废渣"))),
    Rule("工艺流程", ("工艺流程", "流程图")),
    Rule("工艺流程", ("制备", "提纯", "除杂"), (("流程", "滤液", "滤渣", "废液", "矿石", "粗盐"),)),
    Rule("质量守恒与方程式计算", ("质量守恒", "化学方程式计算")),
    Rule("质量守恒与方程式计算", ("根据化学方程式",), (("计算", "质量"),)),
    Rule("表格图像综合计算", ("表格与图像", "表格与坐标")),
    Rule("表格图像综合计算", ("表格", "坐标", "图像", "曲线"), (("计算", "质量分数", "反应后"),)),
    Rule("化合价与化学式", ("化合价",)),
    Rule("化合价与化学式", ("化学式",), (("化合价", "质量比", "质量分数"),)),
    Rule("方程式配平", ("配平", "方程式缺项", "待定系数")),
    Rule("水的净化", ("水的净化",)),
    Rule("水的净化", ("过滤", "吸附", "蒸馏"), (("硬水", "软水", "净化"),)),
    Rule("科普阅读", ("科普阅读", "阅读理解")),
    Rule("科普阅读", ("资料", "短文"), (("阅读", "信息"),)),
    Rule("推断题", ("[A-H][、,，][B-H][、,，][C-H].*",), (("转化", "推断", "框图", "常见物质", "反应关系"),)),
]

#: What follows from a signature: knowledge tags, problem tags, method.
SIGNATURE_TAGS = [
    ("测定空气中氧气含量", ["空气与氧气"], ["装置原理分析", "误差分析", "实验改进"], "测氧气含量装置模型"),
    ("实验室制取氧气", ["空气与氧气"], ["气体制取", "装置选择"], "制气装置-发生收集检验"),
    ("电解水实验", ["水与净化"], ["实验现象推理"], "电解水正负极与体积比"),
    ("控制变量实验", ["科学探究"], ["控制变量", "实验设计"], "变量控制-单一变量比较"),
    ("排除干扰因素", ["科学探究"], ["干扰排除", "实验设计"], "干扰因素识别与排除"),
    ("催化剂探究", ["空气与氧气", "科学探究"], ["催化剂探究", "控制变量"], "催化效果变量比较"),
    ("燃烧条件探究", ["燃烧与能源"], ["实验探究"], "燃烧条件三要素"),
    ("溶解度曲线", ["溶液与溶解度"], ["图像读取", "溶液状态判断"], "溶解度曲线读图"),
    ("溶液稀释与质量分数", ["溶液与溶解度"], ["溶液计算"], "溶质守恒计算"),
    ("酸碱中和pH图像", ["酸碱盐"], ["图像分析", "反应后溶质判断"], "酸碱滴加pH曲线"),
    ("酸碱盐性质探究", ["酸碱盐"], ["实验探究", "物质成分检验"], "酸碱盐反应与现象判断"),
    ("碳酸盐鉴别", ["酸碱盐", "碳与二氧化碳"], ["离子鉴别"], "碳酸盐加酸产气检验"),
    ("NaOH与CO2反应探究", ["碳与二氧化碳", "酸碱盐"], ["数字化实验", "反应证明"], "CO2与NaOH吸收压强模型"),
    ("石灰水与CO2异常", ["碳与二氧化碳", "酸碱盐"], ["异常现象解释"], "CO2与石灰水沉淀转化"),
    ("金属与酸图像", ["金属与材料"], ["图像分析", "定量比较"], "金属酸反应图像"),
    ("金属置换先后", ["金属与材料"], ["反应先后判断"], "金属活动性顺序置换"),
    ("金属回收工艺", ["金属与材料", "工艺流程"], ["工艺流程", "除杂回收"], "金属回收流程"),
    ("工艺流程", ["工艺流程"], ["流程推断", "除杂提纯"], "工艺流程-物质转化与分离"),
    ("推断题", ["推断"], ["物质推断"], "物质转化关系推断"),
    ("质量守恒与方程式计算", ["化学计算"], ["守恒计算", "方程式计算"], "质量守恒-方程式定量"),
    ("表格图像综合计算", ["化学计算"], ["数据处理", "图表计算"], "表格图像综合计算"),
    ("化合价与化学式", ["化学用语"], ["化学式计算"], "化合价与化学式规则"),
    ("方程式配平", ["化学用语"], ["方程式配平"], "方程式守恒配平"),
    ("水的净化", ["水与净化"], ["实验操作", "净化流程"], "水净化操作流程"),
    ("科普阅读", ["化学与生活"], ["信息提取"], "科普阅读信息提取"),
]

#: Visual anchors of the third generation.
ANCHORS = [
    *Rule.of(
        [
            ("U型管", ["U型管", "U 形管", "红墨水", "压强", "液面"]),
            ("注射器", ["注射器", "推注", "活塞"]),
            ("集气瓶/锥形瓶", ["集气瓶", "锥形瓶", "烧瓶", "广口瓶"]),
        ]
    ),
    Rule("CO2-NaOH反应证明", (), (_CO2, _NAOH)),
    *Rule.of(
        [
            ("加酸产生气泡", ["稀盐酸", "盐酸", "气泡", "碳酸钠", "碳酸盐"]),
            ("流程图", ["流程图", "工艺流程", "滤液", "滤渣", "废液", "废渣", "制备", "回收", "提纯"]),
            ("实验装置图", ["装置", "实验", "仪器", "导管", "试管", "烧杯", "水槽"]),
            ("表格数据", ["表格", "数据", "记录", "实验次数", "质量/g", "加入"]),
            ("坐标曲线", ["坐标", "曲线", "图像", "pH", "溶解度曲线", "折线"]),
            ("溶解度曲线", ["溶解度曲线", "溶解度", "饱和溶液", "结晶"]),
            ("pH曲线", ["pH", "中和反应", "滴加", "酸碱"]),
            ("金属酸图像", ["金属", "盐酸", "稀硫酸", "氢气", "活动性"]),
            ("推断框图", ["推断", "框图", "转化关系", "A、B", "A～"]),
            ("科普阅读材料", ["科普阅读", "阅读理解", "资料", "短文"]),
            ("制气装置", ["制取氧气", "制取二氧化碳", "发生装置", "收集装置"]),
            ("控制变量对照", ["控制变量", "对照实验", "影响因素", "变量"]),
        ]
    ),
]

PROCESS_CONTEXT = [
    "工艺流程", "流程图", "滤液", "滤渣", "废液", "废渣", "酸浸", "碱浸", "焙烧", "灼烧", "制备", "提纯", "吸收塔", "合成塔", "反应塔",
    "气化炉", "变换炉", "设备1", "设备2", "反应器", "母液", "产物", "副产物", "返回", "循环使用的物质", "循环利用的物质",
]
PROMPT_WORDS = ["如图", "图1", "图2", "图3", "图示", "流程图", "装置", "曲线", "坐标", "表格", "表中", "由图", "结合图", "数据如表"]
FALSE_TRIGGERS = ["循环利用", "可回收物", "绿色发展", "正确的是", "错误的是", "符合这一理念"]

#: Types of questions and the types of candidates they may be matched with, besides their own; by generation.
ROUTES = {
    "v3": [("科学探究题", "基本实验题"), ("基础题", "综合应用题"), ("综合应用题", "综合应用题")],
    "v5": [
        ("项目式探究题", "科学探究题"), ("项目式探究题", "科普阅读题"), ("科学探究题", "基本实验题"),
        ("基本实验题", "科学探究题"), ("选择题图像题", "计算题"),
    ],
}
ROUTES["v4"] = ROUTES["v5"]

#: Cascades of question types, by generation: the first row that holds gives the type.
_TASKED = Case("项目式探究题", ("任务一", "任务二", "任务三", "设计一份", "方案设计", "项目式", "跨学科实践", "实践活动", "真实情境"), longer=450)
_READING = Case("科普阅读题", ("科普阅读", "阅读理解", "阅读下面", "短文", "回答"), longer=350)
_DEDUCED = Case("推断题", ("推断", "转化关系", "框图"), also=("A", "B", "C", "甲", "乙"))
_PICTURED = Case("选择题图像题", ("溶解度曲线", "pH", "图像", "曲线", "坐标"), named=("选择", "下列"), shorter=420)
_COUNTED = Case("计算题", ("计算", "质量分数", "根据化学方程式", "样品", "表格", "坐标", "曲线"), also=("质量", "数据", "g", "完全反应", "分数"))
_EXPLORED = Case("科学探究题", ("探究", "猜想", "实验探究", "实验再探究", "控制变量", "对照实验", "数字化", "传感器", "异常现象", "排除干扰"))
_DEVICES = Case("基本实验题", ("装置", "仪器", "制取", "收集", "检验", "过滤", "蒸发", "电解水", "燃烧条件"))
TYPE_CASES = {
    "g3": [
        Case("工艺流程题", ("工艺流程", "流程图", "制备", "回收", "废液", "废渣", "矿石", "提纯")),
        Case("科普阅读题", ("科普阅读", "阅读理解", "资料", "短文", "科技", "信息")),
        Case("推断题", ("推断", "框图", "已知A", "A、B", "A~", "A～", "转化关系")),
        Case("计算题", ("计算", "质量分数", "根据化学方程式", "样品", "图像", "坐标", "表格"), also=("g", "质量", "分数", "数据", "曲线", "坐标", "计算")),
        Case("科学探究题", ("探究", "猜想", "对照", "控制变量", "影响因素", "数字化", "传感器", "实验方案")),
        Case("基本实验题", ("实验", "装置", "操作", "仪器", "制取", "过滤", "蒸发", "检验")),
    ],
    "v3": [
        Case("工艺流程题", ("工艺流程", "流程图", "滤液", "滤渣", "废液", "废渣", "回收", "提纯", "制备")),
        Case("科普阅读题", ("科普阅读", "阅读理解", "资料", "短文")),
        Case("推断题", ("推断", "框图", "转化关系"), also=("A", "B", "C", "甲", "乙")),
        Case("科学探究题", ("探究", "猜想", "实验探究", "实验再探究", "反思总结", "控制变量", "对照实验", "数字化", "传感器")),
        _COUNTED,
        Case("基本实验题", ("装置", "仪器", "制取", "收集", "检验", "过滤", "蒸发")),
    ],
    "v4": [
        _TASKED,
        Case("工艺流程题", ("工艺流程", "流程图", "吸收塔", "合成塔", "气化炉", "变换炉", "滤液", "滤渣", "酸浸", "焙烧", "电解", "可循环", "循环利用")),
        _READING, _DEDUCED, _PICTURED, _COUNTED, _EXPLORED, _DEVICES,
    ],
    "v5": [
        _TASKED,
        Case(
            "科普阅读题", ("阅读下列材料", "绿色储粮", "气调储粮", "储粮大国", "仓储技术"),
            none_of=("工艺流程", "流程图", "滤液", "滤渣", "吸收塔", "合成塔", "循环使用的物质", "循环利用的物质"),
        ),
        Case("工艺流程题", tuple(PROCESS_CONTEXT)),
        _READING, _DEDUCED, _PICTURED, _COUNTED, _EXPLORED, _DEVICES,
    ],
}
#: Composite types, words of demanding questions, and tags that mean nothing outside a process.
COMPOSITE_TYPES = ("科学探究题", "工艺流程题", "推断题", "计算题", "综合应用题")
HARD_WORDS = ["综合", "创新", "数字化", "异常", "多次", "继续实验", "坐标", "曲线", "多步"]
PROCESS_TAGS = {"visual": ["流程图", "设备流程", "循环物质"], "task": ["找循环物质"], "task_model": ["循环物质判断"], "method": ["可循环物质判断"]}
#: Types and the words of a video's name that give them.
NAME_TYPES = [
    ("工艺流程题", ["工艺流程", "流程题", "金属回收", "粗盐提纯", "除杂", "制备"]),
    ("计算题", ["计算", "质量分数", "溶解度曲线", "表格与图像", "表格与坐标", "图像坐标", "方程式"]),
    ("推断题", ["推断"]),
    ("科普阅读题", ["科普阅读", "阅读理解"]),
    ("科学探究题", ["探究", "实验", "控制变量", "NaOH与CO2", "二氧化碳", "测定空气", "制取氧气"]),
]
#: What a question has where no signature says it: problems by type, and what its text binds the answer to.
TYPE_PROBLEMS = {
    "基础题": "概念辨析/性质判断", "基本实验题": "实验操作与现象判断", "科学探究题": "实验设计与证据推理", "工艺流程题": "流程转化与除杂提纯",
    "计算题": "定量关系建模", "推断题": "物质转化推断", "科普阅读题": "信息提取与迁移应用",
}
OTHER_PROBLEM, NO_KNOWLEDGE, NO_CONSTRAINT = "综合信息分析", "综合/待复核", "题干条件直接判断"
CONSTRAINTS = [
    ("依赖图表/数据读取", ["图", "曲线", "坐标", "表"]),
    ("单一变量与对照组", ["控制变量", "对照"]),
    ("试剂用量/反应程度", ["过量", "少量", "恰好", "完全反应"]),
]
#: Everyday contexts, and the task models, readings and tables that let a choice question in.
LIFE_WORDS = [
    "绿色发展", "垃圾分类", "可回收物", "生态环境", "人与自然", "工业污水", "露天焚烧", "农药化肥",
    "保护水资源", "生活垃圾", "一次性塑料", "环保", "低碳", "节能", "食品", "营养", "安全标识",
]
ALLOWED_TASKS = ["共存判断", "图像匹配", "循环物质判断", "入口/出口/步骤作用判断"]
READING_WORDS = ["阅读下列材料", "阅读下面", "阅读材料", "科普短文", "短文"]
GRAPH_WORDS = ["坐标图", "坐标曲线", "变化曲线", "纵坐标", "横坐标", "随时间变化"]
TABLE_WORDS = ["表格", "表中", "下表", "如下表", "数据如表", "记录表", "表所示"]
REACTION_WORDS = ["计算", "质量守恒", "质量分数", "完全反应"]
#: Reading material: tasks, forms and methods by which two pieces ask for the same.
READING_TASKS = ["信息提取", "解释原因", "判断入口/操作"]
READING_FORMS = ["曲线图", "表格", "题组材料", "数字化曲线"]
READING_METHODS = ["图表信息提取", "控制变量", "数字化曲线分析"]
#: Words of the conclusions and reasons of a review.
KEEP, DEMOTE, REPLACE = "保留", "降级过程库", "替换截图"
WHY = {
    "choice": "选择题入口过滤：只保留坐标图像、表格计算、含流程图、离子共存、科普材料题组",
    "basic": "基础常识选择题，生活语境循环利用不等于工艺流程循环物质判断",
    "no_visual": "缺少题图/图表/流程/装置等视觉证据，不能仅凭关键词进入宣传版",
    "chapter": "只同章节/素材标签，外观、任务模型和解法模型都不够明确",
    "first_eye": "第一眼不像，且缺少任务模型或解法相似兜底",
    "reading": "科普阅读题需题图/截图一眼像，不能仅凭方程式计算或图表提取标签进宣传版",
    "pool": "视频不在同题型池，且无设问任务同构支撑",
    "vague": "命中说明不够具体，需要补充外观/任务/方法相似点",
    "no_part": "缺少可展示截图",
    "support": "宣传支撑不足，未同时满足视觉/题型/任务/解法中的两项强支撑",
    "passed": "通过v5选择题收紧预审",
    "excluded": "人工审计：不进入宣传版",
    "allowed": "人工白名单审计通过",
    "listed": "人工白名单指定相似题",
    "low": "宣传版阈值不足",
    "none_shown": "没有可展示截图",
    "stronger": "同题已保留更强证据",
    "no_match": "未达到v5选择题收紧版展示标准",
    "compared": "对比表展示层：任务/解法相似",
    "compared_listed": "对比表展示层：人工指定相似课",
}
#: The side that counts more by type, where no signature names a method.
KNOWLEDGE_FIRST, PROBLEM_FIRST = "knowledge优先", "problem优先"
KNOWLEDGE_TYPES = ("基础题", "基本实验题")
#: Edits of a video's labels by words of its name (ord, words of the name, family, op, tags).
NAME_EDITS = [
    (1, "项目式", "primary_type", "set", ["项目式探究题"]),
    (2, "跨学科", "primary_type", "set", ["项目式探究题"]),
    (3, "实践活动", "primary_type", "set", ["项目式探究题"]),
    (4, "主题式探究", "primary_type", "set", ["项目式探究题"]),
    (5, "制氧机", "primary_type", "set", ["项目式探究题"]),
    (6, "空间站", "primary_type", "set", ["项目式探究题"]),
    (7, "水为主题", "primary_type", "set", ["项目式探究题"]),
    (8, "生产甲醇", "primary_type", "set", ["工艺流程题"]),
    (9, "生产甲醇", "visual", "add", ["流程图", "设备流程"]),
    (10, "生产甲醇", "background", "add", ["甲醇生产"]),
    (11, "生产甲醇", "method", "add", ["设备流程分析"]),
    (12, "价类图与工艺流程", "primary_type", "set", ["工艺流程题"]),
    (13, "价类图与工艺流程", "visual", "add", ["流程图", "循环物质"]),
    (14, "价类图与工艺流程", "method", "add", ["可循环物质判断"]),
    (15, "科普阅读", "primary_type", "set", ["科普阅读题"]),
    (16, "科普阅读", "visual", "add", ["题组材料", "曲线图", "表格"]),
    (17, "共存", "task_model", "add", ["共存判断"]),
    (18, "共存", "task", "add", ["共存判断"]),
]
#: How shared labels are named in the reason of a match and in the note on a part of its evidence; words that make a reason specific.
REASON_LABELS = [
    ("视觉形态相似：", "visual"), ("背景素材相似：", "background"), ("设问任务相似：", "task"), ("设问任务同构：", "task_model"), ("解法模型相似：", "method"),
    ("核心实验模型相同：", "core"),
]
NOTE_LABELS = [("图文外观同为", "visual"), ("设问任务同为", "task"), ("学生解题动作同为", "task_model"), ("解法模型同为", "method")]
SPECIFIC_WORDS = ["视觉形态相似", "设问任务同构", "设问任务相似", "解法模型相似", "同为", "U型管", "流程", "题组", "项目式", "科普阅读形式相似", "同构"]
#: Other reasons of a match.
SAID = {
    "same_type": "同为", "projects": "同为项目式探究题，均以真实情境任务链考查综合解决问题", "form": "科普阅读形式相似：",
    "theme": "素材主题与课内例题同构，宣传版截图前置", "data": "数据作答方式与课内例题同构，宣传版截图前置",
}
#: Why a choice question may take part.
CHOICE_WHY = {
    "free": "非选择题", "reading": "科普材料题组", "coexist": "离子/物质共存选择题", "process": "含流程图选择题", "graph": "坐标图像选择题", "table": "表格计算选择题",
    "other": "非白名单选择题",
}
