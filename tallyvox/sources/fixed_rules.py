"""The default rule pack, expression rules, synonyms, topics and sentiment words.

Rule rows are (canonical_key, name, priority, any_patterns, all_patterns, exclude_patterns).
"""

DEFAULT_PACK_ID = "default"
DEFAULT_PACK_VERSION = "default:v2"
EXPRESSION_VERSION = "platform:expression:v1"
GENERAL_TOPIC = "topic_general"
OTHER_EXPRESSION = "expr_other"
OTHER_EXPRESSION_NAME = "其他"

TOPIC_RULES = [
    ("topic_matchmaking", "匹配/组队", 90,
     ["匹配", "组队", "排队太久", "匹配慢", "匹配不到人", "开黑", "配不到", "匹不到", "排不到", "队友", "组不到队"],
     [], []),
    ("topic_gameplay", "玩法/平衡", 80,
     ["平衡性", "数值", "玩法", "关卡设计", "打不过", "太简单", "太难", "副本", "爆率", "出金", "爆金", "摸金",
      "怪物", "地图", "棺", "文物", "难度", "恶心"],
     [], ["闪退", "卡死", "崩溃"]),
    ("topic_visual", "画面/性能", 70,
     ["画面", "美术", "建模", "特效", "掉帧", "发烫", "耗电", "画质", "画风", "皮肤", "曝光", "亮度", "清晰", "建模"],
     [], []),
    ("topic_stability", "稳定性/bug", 95,
     ["闪退", "卡死", "崩溃", "打不开", "黑屏", "bug", "报错", "卡住不动", "进不去", "闪退", "白屏", "无响应"],
     [], ["充值", "登录"]),
    ("topic_network", "网络/登录", 92,
     ["登录不上", "登录失败", "登不上", "进不去游戏", "网络", "延迟", "掉线", "卡顿", "断线", "服务器", "网卡",
      "460", "延迟高"],
     [], ["充值", "退款"]),
    ("topic_payment", "付费/经济", 88,
     ["充值", "到账", "未到账", "扣了", "道具丢失", "道具消失", "648", "648党", "氪金", "圈钱", "骗钱"],
     [], []),
    ("topic_social", "社交/举报/外挂", 60,
     ["举报", "挂机", "外挂", "辱骂", "违规", "作弊", "喷子", "开挂", "外挂多", "全是挂"],
     [], []),
    ("topic_content", "内容/版本/活动", 50,
     ["新版本", "活动", "更新内容", "赛季", "联动", "剧情", "更新", "版本", "新地图", "新活动"],
     [], []),
    ("topic_service", "客服/封号/申诉", 65,
     ["客服", "封号", "申诉", "账号找回", "找回账号", "换绑", "账号异常", "盗号", "被盗", "号被盗", "账号被盗"],
     [], []),
]

EXPRESSION_RULES = [
    ("expr_suggestion", "建议/诉求", 40,
     ["建议", "希望", "能不能", "可不可以", "应该", "优化", "提议", "加个", "加点", "求加", "最好能"], [], []),
    ("expr_complaint", "吐槽/不满", 30,
     ["差", "坑", "劝退", "退游", "失望", "垃圾", "崩溃", "气死", "闪退", "太烂", "无语", "恶心"], [], []),
    ("expr_praise", "好评/推荐", 20,
     ["好玩", "推荐", "安利", "良心", "神作", "喜欢玩", "真香", "惊艳", "值得玩", "不错哦"], [], []),
    ("expr_neutral", "体验分享", 10,
     ["玩了", "总体来说", "个人感觉", "体验了一下", "怎么样", "请问", "小时", "总的来说"], [], []),
]

SYNONYMS = [
    (["登不上", "登不进去", "上不去", "进不去游戏", "卡在登录", "登入不了"], "登录失败"),
    (["充了没到", "充值没到账", "充值没收到"], "充值失败"),
    (["掉东西", "东西没了"], "道具消失"),
    (["挂太多", "全是挂", "开挂", "多队挂"], "外挂"),
    (["卡了", "有点卡", "很卡", "一卡"], "卡顿"),
    (["画质", "画风"], "画面"),
    (["配不到队友", "匹不到", "排不到", "组不到队"], "匹配不到人"),
    (["号被盗", "被盗号", "盗了号"], "盗号"),
    (["出金率", "爆金"], "爆率"),
]

# (canonical_key, name, alert_eligible, sort_order)
TOPICS = [
    ("topic_matchmaking", "匹配/组队", False, 10),
    ("topic_gameplay", "玩法/平衡", False, 20),
    ("topic_visual", "画面/性能", False, 30),
    ("topic_stability", "稳定性/bug", True, 40),
    ("topic_network", "网络/登录", True, 50),
    ("topic_payment", "付费/经济", True, 60),
    ("topic_social", "社交/举报/外挂", True, 70),
    ("topic_content", "内容/版本/活动", False, 80),
    ("topic_service", "客服/封号/申诉", True, 90),
    ("topic_general", "综合/未指向", False, 100),
]

# Topic words by the keys they serve, then the polarity words and the contrast words.
TOPIC_WORDS = [
    (["bug_network", "network"], ["网络", "掉线", "延迟", "卡顿", "断线"]),
    (["bug_gameplay", "gameplay"], ["玩法", "副本", "关卡", "战斗", "bug", "闪退"]),
    (["graphics"], ["画面", "美术", "建模", "特效"]),
]
POSITIVE_WORDS = ["好", "优秀", "喜欢", "流畅", "惊艳", "不错"]
NEGATIVE_WORDS = ["差", "严重", "卡", "掉线", "闪退", "失望", "垃圾", "崩溃"]
CONTRAST_LONG = "但是"
CONTRAST_SHORT = "但"
