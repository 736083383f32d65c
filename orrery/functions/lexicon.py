"""Word lists and patterns.  Fixed values: results depend on them being exactly these."""

from __future__ import annotations

STOP_ZH = (
    "的 了 在 是 我 有 和 就 不 人 都 一 一个 上 也 很 到 说 要 去 你 会 着 没有 看 好 自己 这 他 她 它 们 那 什么 怎么 为什么 因为 所以 但是 如果 虽然 然而 而且 或者 只是 "
    "已经 可以 这个 那个 这些 那些 吗 啊 呢 吧 呀 哦 嗯 哈 嘛 地 得 与 及 或 并 不仅 还是 以及 通过 进行 使用 利用 基于 采用 具有 我们 你们 他们 它们 大家 本 该 每 各 某 另 其他 其中 之一 等 等等"
).split()

STOP_EN = (
    "the a an is are was were be been being have has had do does did will would could should may might can shall to of in for on with at by from as into through during before after above "
    "below between out off over under again further then once here there when where why how all each every both few more most other some such no nor not only own same so than too very just because "
    "and but or if while that this which who whom what these those about up"
).split()

STOP_ENTITY = "可以 这个 那个 什么 一个 没有 不是 我们 就是 如果 因为 所以 然后 之后 之前 现在 已经 可能 需要 使用 通过 进行 实现 利用".split()

CAUSE_STRONG = ["propose", "demonstrate", "therefore", "enable", "we show that", "our results indicate", "this demonstrates", "this confirms that", "we conclude that", "results in", "leads to"]
CAUSE_WEAK = ["suggesting that", "indicating that", "this implies", "these findings suggest", "attributed to", "due to", "as a result of", "we report the", "we present"]
CAUSE_CHUNK = [*CAUSE_STRONG, "suggesting that", "indicating that", "this implies", "these findings suggest", "we report the"]
EFFECT = ["we demonstrate", "we show", "we find", "our results", "this leads", "demonstrates that", "shows that", "confirms", "achieves", "improves", "outperforms", "enables", "provides", "yields", "results in"]
REVERSE = ["due to", "attributed to", "caused by", "result from", "stem from", "originate from"]
FORWARD = ["leads to", "results in", "enables", "demonstrates that", "confirmed that", "we propose", "we present", "we introduce"]
GENERIC = ["propose", "demonstrate", "therefore"]

SEPARATORS = ["\n\n", "\n", "。\n", ". ", "！", "？", "!", "?", "；", ";", "，", ",", " ", ""]
#: source type -> (mode, most characters, overlap); others: recursive, 2000, 300.
CHUNK_STRATEGIES = {"会话记录": ("section", 1500, 200), "技术笔记": ("markdown", 2500, 200), "会话记录_重写": ("section", 1500, 200), "学术论文": ("causal_density", 2000, 200)}
CHUNK_DEFAULT = ("recursive", 2000, 300)

BOUNDARY = "，,。.;；：:！!？?、()（）【】[]{}「」『』——…\n\t"
NOUN_SUFFIXES = (
    "度量学习方法 自注意力机制 特征空间 神经网络 深度学习 机器学习 知识蒸馏 原型网络 消息队列 微服务架构 性能指标 "
    "注意力 编码器 解码器 生成器 判别器 测试集 验证集 训练集 数据集 基准线 基准测试 "
    "模型 方法 系统 算法 框架 网络 架构 数据 图像 文本 音频 视频 信号 分析 检测 识别 预测 分类 聚类 回归 评估 优化 生成 提取 检索 推理 训练 "
    "引擎 组件 模块 工具 平台 协议 接口 机制 策略 方案 模式 范式 流程 管线 任务 场景 应用 领域 问题 挑战 矩阵 向量 张量 参数 权重 特征 损失 梯度 信息 误差 "
    "性能 质量 效率 精度 准确率 输出 输入 嵌入 法 器 机 仪 剂 体 物 层 块 核 域 场 型 识 码 图 表 卡 性 率 度 量 值 集 流 门 路 线 点 面 差 比 态 势"
).split()
KNOWN_NOUNS = frozenset(
    "知识 模型 数据 算法 代码 系统 结构 任务 策略 方法 网络 概念 信息 原理 状态 类型 框架 特征 参数 权重 损失 梯度 嵌入 编码 架构 机制 场景 应用 领域 问题 引擎 组件 "
    "序列 冗余 分布 集合 关系 差异 影响 效应 过程 阶段 步骤 环节 能力 质量 效率 精度 层次 分支 索引 版本 备份 角色 权限 配置 通道 连接 映射 转化 融合 对齐 引导 驱动".split()
)
CUTOFF_WORDS = "提出 设计 采用 利用 使用 通过 作为 用于 称为 叫做 包括 包含 研究 分析 讨论 介绍 说明 展示 验证 证明 表明 显示 发现 是将 是指 是 有".split()
HEAD_STOPS = frozenset("在 中 上 下 里 内 外 前 后 时 到 入 出 与 和 或 及 而 但 且".split())
BARE_VERBS = frozenset("进行 使用 利用 基于 采用 通过".split())

PREDICATES_ZH = "是 不是 就是 也是 了 着 过 会 能 可以 可能 将 已经 正在 在 把 被 让 使 导致 引起 造成 提出 发现 证明 位于 属于 包含 推进 实现 解决 提高 降低 增加 分为 构成 形成".split()
OBJECT_TRIGGERS = "导致 引起 造成 产生 提出 发现 证明 实现 包含 包括 涉及 分为 推进 推动 提高 降低 需要 要求 基于".split()
VERBS_EN = (
    r"\b(is|are|was|were|has|have|had|do|does|did)\s",
    r"\b(leads?|causes?|results?|enables?|provides?|achieves?|improves?|reduces?|increases?|contains?|includes?|refers?)\s",
    r"\b(demonstrates?|shows?|finds?|concludes?|proposes?|introduces?|presents?)\s",
    r"\b(is based on|consists of|depends on|focuses on)\s",
)

NOISE = (r"(?m)^\d{1,2}:\d{2}(:\d{2})?\s*$", r"(?im)^/*thinking", r"(?m)^[^\w\s]{3,}$", r"(?m)^[-–—=*]{3,}\s*$", r"(?m)^\d{10,}\s*$", r"(?m)^\[.*?\]\s*$")

#: Example aliases; a caller passes the table of its own domain.
ALIASES = {"RAG": ["rag", "检索增强生成", "检索增强"], "Ollama": ["ollama"], "ComfyUI": ["comfyui", "comfy"], "FAISS": ["faiss"]}

SOURCE_TYPES = {"md": "日记", "txt": "笔记", "json": "配置", "py": "代码"}
SOURCE_TYPE_OTHER = "其他"

# What a subject may not end in, and subjects that say nothing.
SUBJECT_TAILS = "通 过 在 把 被 将 从 对 与 和 研 究 表 明 指 出 显 示 说 为 了 着 基 于".split()
SUBJECT_EMPTY = "我们 他们 它们 你们 这个 那个 这些 那些 自己 它 他 她 这 那 本文 本工作 本研究 本论文".split()
